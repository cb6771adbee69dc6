"""Gates: ordered checks with a verdict, configuration within bounds, staleness, and commit predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the caps, and whether a smaller or a larger number is the stricter one.
DEFAULTS = {"REMOVED_LINE_CAP": 200, "REMOVAL_JUDGEMENT_CAP": 30, "SPOT_CHECK_RATE": 0.25, "FUNCTIONAL_DIFF_THRESHOLD": 400, "ADDED_LINE_CEILING": 200, "FLOOR_STALENESS_THRESHOLD_DAYS": 7}
TIGHTER = {k: "larger" if k == "SPOT_CHECK_RATE" else "smaller" for k in DEFAULTS}
ALIASES = {"FLOOR_STALENESS_THRESHOLD": "FLOOR_STALENESS_THRESHOLD_DAYS"}
MARKS = ("consolidation:", "mechanical:")


def config(raw: Column, tracked: Column) -> Column:
    """Struct of the caps from a JSON text: defaults for what is absent or no number, old names taken; untracked text may only tighten."""
    fields = []
    for name, default in DEFAULTS.items():
        names = [name, *(a for a, n in ALIASES.items() if n == name)]
        given = F.coalesce(*(F.get_json_object(raw, f"$.{n}").try_cast("double") for n in names))
        bound = F.least(given, F.lit(float(default))) if TIGHTER[name] == "smaller" else F.greatest(given, F.lit(float(default)))
        value = F.when(given.isNull(), float(default)).when(tracked, given).otherwise(bound)
        fields.append(value.alias(name))
    return F.struct(*fields)


def unknown_keys(raw: Column) -> Column:
    """Keys of a configuration text that mean nothing, in order."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*map(F.lit, (*DEFAULTS, *ALIASES)))))


def verdict(checks: DataFrame, run: str = "run") -> DataFrame:
    """(run, verdict, failed): fail where any check (run, ord, name, outcome) fails, advisory where any advises, else ok; failed names in order."""
    bad = F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == "fail", F.struct("ord", "name")))), lambda x: x["name"])
    worst = F.max(F.when(F.col("outcome") == "fail", 2).when(F.col("outcome") == "advisory", 1).otherwise(0))
    out = checks.groupBy(run).agg(worst.alias("w"), bad.alias("failed"))
    return out.select(run, F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "advisory").otherwise("ok").alias("verdict"), "failed")


def stale(observed: Column, committed: Column, days: int = 7) -> Column:
    """Whether an observation is older than a commit by more than ``days``; an unreadable date is stale."""
    return F.coalesce(F.datediff(committed.try_cast("date"), observed.try_cast("date")) > days, F.lit(True))


def is_runner_message(message: Column) -> Column:
    """Whether a commit's subject carries one of the runner's marks."""
    subject = F.lower(F.ltrim(F.substring_index(message, "\n", 1)))
    return F.exists(F.array(*map(F.lit, MARKS)), lambda m: subject.startswith(m))


def mechanical_only(diff: DataFrame) -> DataFrame:
    """(sha, mechanical): whether all changed lines (sha, sign, content) of a commit are blank or the same but for white space on both signs."""
    flat = F.regexp_replace("content", r"\s+", "")
    rows = diff.select("sha", flat.alias("c"), F.when(F.col("sign") == "+", 1).otherwise(-1).alias("n")).filter("c <> ''")
    left = rows.groupBy("sha", "c").agg(F.sum("n").alias("n")).groupBy("sha").agg(F.bool_and(F.col("n") == 0).alias("m"))
    return diff.select("sha").distinct().join(left, "sha", "left").select("sha", F.coalesce("m", F.lit(True)).alias("mechanical"))


def verified_prefix(commits: DataFrame, chain: str = "branch") -> DataFrame:
    """Commits (branch, ord, ok) before the first that isn't ok: a history walk as one running minimum."""
    before = F.min(F.col("ok").cast("int")).over(Window.partitionBy(chain).orderBy("ord"))
    return commits.withColumn("__ok", before).filter("__ok = 1").drop("__ok")


def nearest_rule(commits: DataFrame) -> DataFrame:
    """(file, rule): the rule of the nearest commit (file, distance, rule) that has one."""
    return commits.filter("rule is not null").groupBy("file").agg(F.min_by("rule", "distance").alias("rule"))


def spelling_problems(asked: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, problem): paths that aren't tracked, or are under another spelling (case alone differs)."""
    names = tracked.select(F.col("path").alias("spelling"), F.lower("path").alias("k"))
    exact = names.select(F.col("spelling").alias("path"), F.lit(True).alias("exact"))
    near = names.groupBy("k").agg(F.min("spelling").alias("near"))
    rows = asked.select("path").distinct().join(exact, "path", "left").filter("exact is null").withColumn("k", F.lower("path")).join(near, "k", "left")
    return rows.select("path", F.when(F.col("near").isNotNull(), F.concat(F.lit("spelled "), "near")).otherwise("not tracked").alias("problem"))


def build_problems(skills: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    """(name, problem) over (name, description): the naming rules of a package; ``reserved`` words may not stand in a name."""
    rules = F.array_compact(
        F.array(
            F.when(~F.col("name").rlike("^[a-z0-9-]{1,64}$"), "name has other characters or is too long"),
            F.when(F.exists(F.array(*map(F.lit, reserved)).cast("array<string>"), lambda w: F.col("name").contains(w)), "name holds a reserved word"),
            F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "no description"),
            F.when(F.length("description") > 1024, "description is too long"),
            F.when(F.col("description").rlike("[<>]"), "description holds markup"),
        )
    )
    return skills.select("name", F.explode(rules).alias("problem"))


def eval_problems(cases: DataFrame) -> DataFrame:
    """(skill, id, problem) over (skill, id, prompt, assertions, files): ids used twice, empty prompts and assertions, files outside the skill."""
    bad = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("prompt"), F.lit("")) == "", "no prompt"),
            F.when(F.coalesce(F.size("assertions"), F.lit(0)) <= 0, "no assertions"),
            F.when(F.exists("assertions", lambda a: a.isNull() | (F.trim(a) == "")), "an empty assertion"),
            F.when(F.exists("files", lambda f: f.startswith("/") | f.rlike(r"(^|/)\.\.(/|$)")), "a file outside the skill"),
        )
    )
    twice = cases.groupBy("skill", "id").count().filter("count > 1").select("skill", "id", F.lit("id used twice").alias("problem"))
    return cases.select("skill", "id", F.explode(bad).alias("problem")).unionByName(twice)


def style(document: Column, profile: Column, default: Column) -> Column:
    """A setting by precedence: the document's, else the profile's, else the default; blank ones don't count."""
    return F.coalesce(F.nullif(F.trim(document), F.lit("")), F.nullif(F.trim(profile), F.lit("")), default)


def valid_color(value: Column) -> Column:
    """A colour as six hex digits in upper case, null for anything else."""
    return F.when(F.trim(value).rlike("^#?[0-9A-Fa-f]{6}$"), F.upper(F.regexp_replace(F.trim(value), "^#", "")))
