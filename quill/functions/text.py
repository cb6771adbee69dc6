"""Text column functions: normal forms, content keys, predicates and tokens, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
REDACTED = "«REDACTED»"
MARKERS = r"\b(TODO|TBD|FIXME|XXX)\b|«REDACTED»"
NAME_PARTICLES = ("de", "di", "da", "del", "della", "dei", "van", "von", "der", "den", "le", "la", "du", "y")
RTL_RANGES = ((0x0590, 0x05FF), (0x0600, 0x06FF), (0x0700, 0x074F), (0x0750, 0x077F), (0x0780, 0x07BF), (0x07C0, 0x07FF), (0x08A0, 0x08FF), (0xFB1D, 0xFB4F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
NARRATION_VERBS = (
    "call", "create", "set", "get", "check", "load", "save", "return", "then", "now",
    "iterate", "loop", "parse", "print", "write", "read", "open", "close", "init",
    "fetch", "send", "update", "delete", "remove", "add", "use",
)
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
FRAGMENT_PATTERNS = (
    r"\b[A-Z][A-Z0-9]+-\d+\b",
    r"#\d{3,}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"(?i)\b\d{1,2} (?:" + "|".join(MONTHS) + r") \d{4}\b",
)
PHONETIC = ("pvfcqgtzxwy", "bbbkkkdssui")


def norm(s: Column) -> Column:
    """Lower case, trimmed, white space collapsed; null as ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"(?U)\s+", " "))


def letters_norm(s: Column) -> Column:
    """Lower case with only digits and Latin letters up to ÿ."""
    return F.regexp_replace(F.lower(s), "[^0-9a-zà-ÿ]", "")


def skeleton(n: Column) -> Column:
    """A rough sound key: like consonants merged, vowels and h dropped, doubles collapsed."""
    return F.regexp_replace(F.regexp_replace(F.translate(n, *PHONETIC), "[aeiouàèéìòùh]", ""), r"(.)\1+", "$1")


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the text with two spaces before and one after."""
    padded = F.concat(F.lit("  "), s, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(...))"), 1))  # one pass; cutting by position would scan from the start each time


def fingerprint(path: Column, occurrence: Column, body: Column) -> Column:
    """Content key of a unit: 8 hex digits over its path, its place among equal bodies and its body."""
    return F.substring(F.sha1(norm(F.concat(path, F.lit("\n"), occurrence.cast("string"), F.lit("\n"), body)).cast("binary")), 1, 8)


def short_sha1(s: Column, digits: int) -> Column:
    return F.substring(F.sha1(s.cast("binary")), 1, digits)


def image_key(url: Column, mime: Column) -> Column:
    """File name of a picture: 12 hex digits of its URL's md5 and an extension by type."""
    ext = F.substring_index(F.substring_index(mime, "/", -1), "+", 1)
    return F.concat(F.substring(F.md5(url.cast("binary")), 1, 12), F.lit("."), F.when(ext == "jpeg", "jpg").otherwise(ext))


def is_rtl(text: Column) -> Column:
    """Whether letters of right-to-left blocks outnumber all other letters."""
    block = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in RTL_RANGES)
    rtl = F.regexp_count(text, F.lit(f"[{block}]"))
    other = F.regexp_count(text, F.lit(f"[\\p{{L}}&&[^{block}]]"))
    return rtl > other


def is_name(s: Column) -> Column:
    """Whether a text looks like a person's name or a speaker label: 1 to 5 capitalised words, particles allowed."""
    t = F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), r"^[\[\]]+|[\[\]]+$", "")
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    words = F.split(t, r"(?U)\s+")
    capital = lambda w: w.rlike(r"^\p{Lu}")
    label = t.rlike(r"^(SPEAKER_\d+|Speaker \d+|spk_\d+|[A-Z])$")
    return label | ((t != "") & F.size(words).between(1, 5) & capital(words[0]) & F.forall(words, lambda w: capital(w) | F.lower(w).isin(*NAME_PARTICLES)))


def lang_code(s: Column) -> Column:
    """Primary language code; 'en' for null or blank."""
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(s, F.lit("")))), "^[^-_]*", 0)
    return F.when(code == "", "en").otherwise(code)


def fragments(text: Column, patterns: tuple[str, ...] = FRAGMENT_PATTERNS) -> Column:
    """Ticket ids, issue numbers and dates in a text, pattern by pattern, each once."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 0) for p in patterns))
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"(?U)[\s,;]+", " ")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def comment_body(text: Column) -> Column:
    """Comment text without its markers, line by line, outer blank lines off."""
    head = r"(?m)^\s*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|'|::|(?i:rem)\b)\s?"
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "^" + head[5:], ""), r"\s*(?:\*+/|-->)\s*$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


CODE_LINE = (
    r"[;{}]\s*$|^\s*[}\])]|^\s*[\w.$\[\]]+\s*(?:[-+*/%|&^]|<<|>>)?=(?!=)\s*\S"
    r"|^\s*(?:return|import|const|let|var|function|class|if|for|while|else|try|catch|throw|new)\b.*[(){}=;]"
    r"|^\s*[\w.$]+\s*\(.*\)\s*;?\s*$"
)


def code_like(body: Column) -> Column:
    """Whether at least half of the lines that aren't blank are shaped like statements."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    hits = F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE)))
    return (F.size(lines) > 0) & (2 * hits >= F.size(lines))


def unit_facts(text: Column, comment: Column) -> Column:
    """Facts of a unit, '; ' between them: fragment, code-like, separator, long, narration, todo. ``comment`` tells comment units."""
    frags = fragments(text)
    body = F.when(comment, comment_body(text)).otherwise(text)
    n = F.size(F.split(text, "\n", -1))
    first = F.ltrim(F.coalesce(F.element_at(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), 1), F.lit("")))
    parts = F.array(
        F.when(F.size(frags) > 0, F.concat(F.lit("fragment="), F.array_join(frags, ","))),
        F.when(comment & code_like(body), "code-like"),
        F.when(~body.rlike(r"(?U)\w"), "separator"),
        F.when(n >= 5, F.concat(F.lit("long="), n.cast("string"))),
        F.when(comment & first.rlike(r"(?i)^(?:" + "|".join(NARRATION_VERBS) + r")\b"), "narration"),
        F.when(comment & text.rlike(r"(?i)\b(?:TODO|FIXME|XXX|HACK)\b"), "todo"),
    )
    return F.array_join(F.array_compact(parts), "; ")


def slug(s: Column) -> Column:
    """Lower case, everything but letters and digits as one dash, no outer dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def anchor(s: Column) -> Column:
    """Heading anchor as Markdown hosts make it: lower case, marks dropped, spaces as dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"(?U)[^\w\- ]", ""), " ", "-")


def file_safe(s: Column) -> Column:
    """A portable file name part."""
    return F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"[. ]+$", "")


def escape_cell(s: Column) -> Column:
    """Text inside a Markdown table cell: bars escaped, line breaks as <br>."""
    return F.replace(F.replace(s, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def fence(text: Column) -> Column:
    """A backtick fence longer than any run in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def split_row(line: Column) -> Column:
    """Cells of a Markdown table row; an escaped bar stays in its cell."""
    s = F.regexp_replace(F.trim(line), r"\\\|", "\u0001")
    s = F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|$", "")
    return F.transform(F.split(s, r"\|", -1), lambda c: F.trim(F.replace(c, F.lit("\u0001"), F.lit("|"))))


def parse_attributes(s: Column) -> Column:
    """Map of key="value" and key=value pairs."""
    pair = F.lit(r"""([\w-]+)=(?:"([^"]*)"|(\S+))""")
    keys, quoted, bare = (F.regexp_extract_all(s, pair, k) for k in (1, 2, 3))
    values = F.transform(F.arrays_zip(quoted.alias("q"), bare.alias("b")), lambda x: F.concat(x["q"], x["b"]))
    return F.map_from_arrays(keys, values)


def markdown_to_text(text: Column) -> Column:
    """Markdown lines without heading, list, quote, link, emphasis and rule marks."""

    def plain(s: Column) -> Column:
        s = F.rtrim(s)
        for pattern, put in ((r"^\s{0,3}#{1,6}\s+", ""), (r"^\s*(?:[-*+]|\d+[.)])\s+", ""), (r"^\s*>\s?", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(\*\*|__|\*|_|`)(.+?)\1", "$2")):
            s = F.regexp_replace(s, pattern, put)
        return F.when(s.rlike(r"^\s*(?:[-*_]\s*){3,}$") | ((s != "") & s.rlike(r"^\s*\|?[-:| ]+\|?\s*$")), "").otherwise(s)

    return F.array_join(F.transform(F.split(text, "\r?\n"), plain), "\n")


def strip_tags(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "</?[^>]+>", ""))


def words(s: Column) -> Column:
    """Words between white space; '' has none."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def is_subsequence(short: Column, whole: Column) -> Column:
    """Whether the words of ``short`` stand in ``whole`` in order: a strip deletes and nothing else."""
    at = F.aggregate(whole, F.lit(0), lambda i, w: F.when(F.get(short, i) == w, i + 1).otherwise(i))
    return at == F.size(short)
