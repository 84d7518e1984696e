"""Rules of the triage as Column expressions, and the lists they use."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell import schema as S

# Extensions of each file category; any other extension is "binary".
EXTENSIONS = {
    "text": "cer cfg conf crt csr csv eml emlx emlxpart env htm html ics ini json key log mbox md netrc npmrc pem pgpass plist properties pub rtf svg tfvars toml txt vcf wifi xml yaml yml",
    "code": "ahk bat c cmake cpp cs css dart dockerfile erl ex exs fish go gradle groovy h hcl hs java jl js kt less lua m mk mm nix php pl ps1 psd1 psm1 py pyi pyx r rb rs scala scss sh sql svelte swift tf ts vbs vue zsh",
    "doc": "doc docx odt pdf xlsx",
    "image": "avif bmp cr2 gif heic ico jpeg jpg png raw tif tiff webp",
    "archive": "7z gz rar tar zip",
    "av": "avi mkv mov mp3 mp4 wav",
    "generated": "anim asset controller cubemap mat meta physicmaterial prefab unity",
}
# Directories that are never entered.
SKIPPED_DIRS = (
    "$recycle.bin", "$winreagent", ".cache", ".cargo", ".git", ".gradle", ".idea", ".m2", ".mypy_cache", ".npm", ".nuget",
    ".pnpm-store", ".pytest_cache", ".ruff_cache", ".rustup", ".thumbnails", ".tox", ".trash-1000", ".venv", ".vs",
    ".vscode-server", ".yarn", "__pycache__", "cache", "cacheddata", "caches", "code cache", "gpucache", "intel",
    "node_modules", "perflogs", "program files", "program files (x86)", "programdata", "recovery", "shadercache",
    "site-packages", "system volume information", "temp", "tmp", "venv", "windows", "xboxgames",
)
SKIPPED_LINUX_DIRS = ("bin", "boot", "cdrom", "dev", "lib", "lib64", "lost+found", "media", "mnt", "proc", "run", "sbin", "snap", "sys", "usr")
# Build directories that are skipped beside one of these names or endings.
MARKERS = (
    (("library", "temp", "logs", "obj"), ("projectsettings", "assets"), ()),
    (("target",), ("cargo.toml", "pom.xml"), ()),
    (("bin", "obj"), (), (".csproj", ".sln")),
    (("build",), ("gradlew", "cmakelists.txt", "package.json"), ()),
    (("dist", ".next", ".nuxt", "coverage"), ("package.json",), ()),
    (("vendor",), ("composer.json", "go.mod"), ()),
)
# Binary extensions whose files are never sniffed for text, documents that can be read, images that can be recognised.
NEVER_SNIFFED = "a bin class dat db dll dylib exe img iso kdbx lib msi node o p12 pfx pyc so sqlite sqlite3 sys vhd vmdk wasm".split()
READABLE_DOCS = "doc docx pdf xlsx".split()
OCR_IMAGES = "bmp gif jpeg jpg png tif tiff webp".split()
HASHED_CATEGORIES = ("text", "code", "doc")


def category_of(ext: str) -> str:
    return next((c for c, names in EXTENSIONS.items() if ext.lower() in names.split()), "binary")


def categorize(ext: Column) -> Column:
    """The file category of an extension."""
    pairs = [(F.lit(e), F.lit(c)) for c, names in EXTENSIONS.items() for e in names.split()]
    return F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable(pairs)), F.lower(ext)), F.lit("binary"))


def is_skipped_dir(name: Column, parent_parts: Column) -> Column:
    """Directories skipped by their own name and those above them."""
    own, above = F.lower(name), F.lower(F.coalesce(F.try_element_at(parent_parts, F.lit(-1)), F.lit("")))
    return own.isin(*SKIPPED_DIRS, *SKIPPED_LINUX_DIRS) | ((above == "appdata") & own.isin("local", "locallow")) | ((above == "var") & (own != "mail"))


def skips_dir(name: str, parent_parts: list[str]) -> bool:
    """``is_skipped_dir`` for the reader of a filesystem."""
    own, above = name.lower(), parent_parts[-1].lower() if parent_parts else ""
    return own in SKIPPED_DIRS or own in SKIPPED_LINUX_DIRS or above == "appdata" and own in ("local", "locallow") or above == "var" and own != "mail"


def skips_beside(name: str, siblings: set[str]) -> bool:
    """Whether a build directory has one of its markers among its siblings' lower-case names."""
    return any(name.lower() in dirs and (not siblings.isdisjoint(marks) or any(s.endswith(ends) for s in siblings if ends)) for dirs, marks, ends in MARKERS)


def is_skipped_beside(name: Column, siblings: Column) -> Column:
    """``skips_beside`` over a name and an array of lower-case sibling names."""
    found = F.lit(False)
    for dirs, marks, ends in MARKERS:
        beside = F.arrays_overlap(siblings, F.array(*map(F.lit, marks))) if marks else F.lit(False)
        for end in ends:
            beside = beside | F.exists(siblings, _ends_with(end))
        found = found | (F.lower(name).isin(*dirs) & F.coalesce(beside, F.lit(False)))
    return found


def _ends_with(end: str) -> Callable[[Column], Column]:
    return lambda name: name.endswith(end)


def is_hashed(category: Column, size: Column) -> Column:
    return category.isin(*HASHED_CATEGORIES) & (size <= S.HASH_CEILING)


def is_sniffed(category: Column, ext: Column, size: Column) -> Column:
    return (category == "binary") & ~ext.isin(*NEVER_SNIFFED) & (size <= S.SNIFF_CEILING)


def is_extractable(category: Column, ext: Column, size: Column) -> Column:
    """Whether some text can be read from a file of this kind."""
    return category.isin("text", "code") | ext.isin(*READABLE_DOCS) | is_sniffed(category, ext, size)


def verified_label(status: Column) -> Column:
    return F.when(status.isNull(), "unknown").when(status == "ocr", "ocr").when(status == "ok", "content").otherwise("name-only")


def was_name_only(status: Column, category: Column) -> Column:
    """Judged without content: by its status, or for old rows by its category. The status ``ocr`` counts too."""
    return F.when(status.isNotNull(), status != "ok").otherwise(~F.coalesce(category.isin(*HASHED_CATEGORIES), F.lit(False)))


def is_valid() -> Column:
    return no_error() & F.col("value_score").isNotNull()


def no_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) == ""


def probability(category: str) -> Column:
    return F.col(f"probabilities.{category}")


def at_least(value: Column, limit: float) -> Column:
    """A comparison that is false for a null."""
    return F.coalesce(value >= limit, F.lit(False))


def is_included(min_value: float = S.MIN_VALUE, min_prob: float = S.MANIFEST_MIN_PROB) -> Column:
    """The inclusion rule over latest rows.

    Errors and generated files never count. Verified rows count by their value
    or by a probability other than original work; others by credentials,
    finance and personal alone.
    """
    sure = [at_least(probability(c), min_prob) for c in ("credentials", "financial_legal", "personal")]
    any_sure = sure[0] | sure[1] | sure[2]
    verified = verified_label(F.col("extraction_status")).isin("content", "ocr")
    more = verified & (at_least(F.col("value_score"), min_value) | at_least(probability("irreplaceable"), min_prob))
    return no_error() & (F.coalesce(F.col("category"), F.lit("")) != "generated") & (any_sure | more)


def is_ocr_eligible(ext: Column) -> Column:
    kind = (F.col("category") == "image") & ext.isin(*OCR_IMAGES) | ((ext == "pdf") & (F.col("extraction_status") == "no_text"))
    return no_error() & was_name_only(F.col("extraction_status"), F.col("category")) & F.coalesce(kind, F.lit(False))


def top_category() -> Column:
    """The most probable category, the first of equals; ``-`` if there is none."""
    most = F.greatest(*(probability(c) for c in S.CATEGORIES))
    found = F.lit("-")
    for c in reversed(S.CATEGORIES):
        found = F.when(probability(c) == most, c).otherwise(found)
    return found


def format_size(size: Column) -> Column:
    """1024-steps without decimals: ``12KB``."""
    units = ("B", "KB", "MB", "GB", "TB")
    text = F.concat(F.format_string("%.0f", F.bround(size / 1024.0**4, 0)), F.lit("TB"))
    for power in range(3, -1, -1):
        scaled = F.bround(size / 1024.0**power, 0)
        text = F.when(size < 1024.0 ** (power + 1), F.concat(F.format_string("%.0f", scaled), F.lit(units[power]))).otherwise(text)
    return text


def systemic(status: Column) -> Column:
    """HTTP statuses that fail every call alike."""
    return F.coalesce(status.isin(*S.BREAKER_STATUSES), F.lit(False))
