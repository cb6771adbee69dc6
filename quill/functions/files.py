"""File kinds and languages by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IMAGE = ".png .jpg .jpeg .gif .bmp .webp .tif .tiff .svg .emf .wmf".split()
OFFICE = ".docx .pdf .pptx .xlsx .xlsm .doc .rtf .odt .xls .ods .ppt .odp".split()
TEXT = ".txt .md .markdown .rst .adoc .csv .tsv .log .text".split()
CONFIG = (
    ".json .xml .config .yaml .yml .ini .env .properties .toml .csproj .vbproj .fsproj .sln .props .targets .gradle .pubxml "
    ".resx .settings .conf .cfg .editorconfig .gitignore .dockerignore"
).split()
CODE = (
    ".cs .vb .fs .ts .tsx .js .jsx .mjs .cjs .py .java .kt .go .rb .php .rs .c .h .cpp .hpp .swift .m .scala .cshtml .razor .vue .svelte "
    ".html .css .scss .less .sql .ps1 .psm1 .sh .bash .bat .cmd .abap .bas .vbs .lua .r .dart .groovy .pl .asax .aspx .ascx .master .xaml .tf"
).split()
BINARY = (
    ".dll .exe .pdb .so .dylib .lib .a .o .obj .class .jar .war .nupkg .zip .7z .rar .tar .gz .tgz .bz2 .iso .msi .cab .bin .dat .db .sqlite "
    ".mdf .ldf .bak .suo .cache .woff .woff2 .ttf .otf .eot .ico .mp3 .mp4 .wav .m4a .avi .mov .mkv .webm .snk .pfx .p12 .keystore .rpt .crt .cer .der .lnk"
).split()
SKIPPED_FOLDERS = (
    ".git .svn .hg .vs .idea .vscode bin obj node_modules packages dist build out target __pycache__ .venv venv env coverage TestResults "
    ".next .nuget .gradle .terraform bower_components"
).split()
SKIPPED_FILES = "package-lock.json yarn.lock pnpm-lock.yaml Thumbs.db .DS_Store desktop.ini packages.lock.json".split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\]*[^./\\][^/\\]*(\.[^./\\]+)$", 1))


def classify(path: Column) -> Column:
    """transcript, mail, image, document, web, text, config, code, binary or other: the first rule that holds."""
    ext, name = extension(path), F.lower(F.regexp_extract(path, r"[^/\\]*$", 0))
    spoken = name.rlike("transcri|trascri")
    source = path.rlike(r"(^|[/\\])(src|wwwroot)([/\\]|$)")
    return (
        F.when(ext.isin(".vtt", ".srt", ".sbv") | (ext.isin(".json", ".tsv", ".csv", *TEXT, *OFFICE) & spoken), "transcript")
        .when(ext.isin(".msg", ".eml"), "mail")
        .when(ext.isin(*IMAGE), "image")
        .when(ext.isin(*OFFICE), "document")
        .when(ext.isin(".html", ".htm", ".mhtml") & ~source, "web")
        .when(ext.isin(*TEXT), "text")
        .when(ext.isin(*CONFIG) | name.isin("dockerfile", "crontab", "makefile"), "config")
        .when(ext.isin(*CODE), "code")
        .when(ext.isin(*BINARY), "binary")
        .otherwise("other")
    )


def is_skipped(path: Column) -> Column:
    """Files that a directory walk leaves out: tool folders, dot folders, lock files, minified files and source maps."""
    folders = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    name = F.substring_index(path, "/", -1)
    return F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS) | (f.startswith(".") & ~f.isin(".", ".."))) | name.isin(*SKIPPED_FILES) | name.rlike(r"\.min\.\w+$|\.map$")
