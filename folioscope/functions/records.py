"""Functions of bibliographic records: links and hosts, names, dates, labels, fingerprints; all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import collapse, normalize_doi, text_or_empty

#: Punctuation behind a link that belongs to the sentence.
TRAILING = ".,;:!?'\"”’)>]}»"
#: Hosts of code by suffix, in order of precedence.
CODE_HOSTS = (
    ("gist.github.com", "GitHub Gist"), ("raw.githubusercontent.com", "GitHub"), ("github.com", "GitHub"), ("github.io", "GitHub"), ("gitlab.com", "GitLab"), ("bitbucket.org", "Bitbucket"), ("osf.io", "OSF"),
    ("datadryad.org", "Dryad"), ("dryad.org", "Dryad"), ("zenodo.org", "Zenodo"), ("figshare.com", "Figshare"), ("codeocean.com", "Code Ocean"), ("sourceforge.net", "SourceForge"), ("huggingface.co", "Hugging Face"),
    ("gitee.com", "Gitee"), ("mybinder.org", "Binder"), ("kaggle.com", "Kaggle"), ("colab.research.google.com", "Colab"), ("code.google.com", "Google Code"), ("savannah.gnu.org", "Savannah"), ("git.io", "GitHub"),
)
#: Archives by a part of a resolver's path.
DOI_HINTS = (("zenodo", "Zenodo"), ("osf.io", "OSF"), ("dryad", "Dryad"), ("figshare", "Figshare"))
#: Small words that belong to a family name.
PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "da", "di", "du", "la", "le", "los", "dos", "bin", "ibn", "al", "ter", "ten", "op", "st")
#: Gates of text layers. Shares of bad and of real letters, words and their lengths that tell lost spaces, least length.
BAD_SHARE, LETTER_SHARE, LEAST_WORDS, MEAN_WORD, LONG_WORD, LONG_SHARE, LEAST_TEXT = 0.05, 0.20, 4, 12.0, 18, 0.15, 8


def clean_url(c: Column) -> Column:
    """A found link without the sentence's punctuation, with a scheme; null if nothing is left."""
    bare = F.rtrim(F.trim(text_or_empty(c)), F.lit(TRAILING))
    return F.when(bare == "", None).when(F.rlike(bare, F.lit("(?i)^https?://")), bare).otherwise(F.concat(F.lit("https://"), F.regexp_replace(bare, "^/+", "")))


def host_of(url: Column) -> Column:
    """Host of a URL, lower case, without www."""
    return F.regexp_replace(F.regexp_extract(F.lower(text_or_empty(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1), r"^www\.", "")


def host_label(url: Column, hosts: tuple[tuple[str, str], ...] = CODE_HOSTS, hints: tuple[tuple[str, str], ...] = DOI_HINTS) -> Column:
    """Label of the first host suffix that fits; a resolver's links go by a hint in their path; null for other hosts."""
    host, path = host_of(url), F.lower(F.regexp_extract(text_or_empty(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1))
    fits = lambda suffix: (host == suffix) | host.endswith("." + suffix)
    label = reduce(lambda w, h: w.when(fits(h[0]), h[1]), hosts, F.when(F.lit(False), F.lit("")))
    return reduce(lambda w, h: w.when(fits("doi.org") & F.contains(path, F.lit(h[0])), h[1]), hints, label)


def doi_in_link(c: Column) -> Column:
    """The DOI of a link or line without a browser's debris: dotted views, closing path words, preprint versions; two parts on MIT Press hosts."""
    c = F.replace(F.replace(text_or_empty(c), F.lit("\\_"), F.lit("_")), F.lit("\\#"), F.lit("#"))
    doi = F.regexp_replace(F.coalesce(normalize_doi(F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})|\+", ""))), F.lit("")), r"(?i)(?:\.full|\.abstract|\.pdf)+$", "")
    doi = F.regexp_replace(F.regexp_replace(F.regexp_replace(doi, "(?i)(?:/html|/_p)$", ""), r"(?i)/?v\d+$", ""), "/+$", "")
    host = host_of(c)
    return F.nullif(F.when((host == "direct.mit.edu") | host.startswith("direct-mit-edu."), F.substring_index(doi, "/", 2)).otherwise(doi), F.lit(""))


def strip_markdown(c: Column) -> Column:
    """A line without list marker, quote mark, heading hashes, bold or italic round all of it, escapes and common entities."""
    c = F.trim(text_or_empty(c))
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    for pattern, to in ((r"^\s{0,3}(?:[-*+]\s+|\d+[.)]\s+)", ""), (r"^\s*>\s?", ""), (r"^#{1,6}\s+", ""), (r"^\*\*(.*?)\*\*$", "$1"), (r"^__(.*?)__$", "$1"), (r"^\*(.*?)\*$", "$1"), (r"^_(.*?)_$", "$1"), (r"\\([_#&])", "$1")):
        c = F.regexp_replace(c, pattern, to)
    return collapse(c)


def doi_to_filename(c: Column) -> Column:
    return F.nullif(F.translate(c, "/\\", "__"), F.lit(""))


def to_base64(c: Column) -> Column:
    return F.base64(c.cast("binary"))


def from_base64(c: Column) -> Column:
    return F.unbase64(c).cast("string")


def sheet_name(c: Column, length: int = 31) -> Column:
    """A worksheet's name: each banned character a space, trimmed, cut to length."""
    return F.substring(F.trim(F.regexp_replace(text_or_empty(c), r"[\[\]:*?/\\]", " ")), 1, length)


def split_name(c: Column) -> Column:
    """(family, given) of a display name: the last word and the particles before it; a single word is the family name."""
    words = F.filter(F.split(F.trim(text_or_empty(c)), r"\s+"), lambda w: w != "")
    n = F.size(words)
    inner = F.transform(words, lambda w, i: F.when((i > 0) & (i < n - 1) & F.lower(F.regexp_replace(w, r"^\.+|\.+$", "")).isin(*PARTICLES), i).otherwise(-1))
    # the family name starts at the first of the particles that reach the last word without a break
    cut = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.struct((n - 1).alias("at"), F.lit(True).alias("on")), lambda a, back: F.struct(F.when(a["on"] & (n - back > 0) & (F.get(inner, n - back) >= 0), n - back).otherwise(a["at"]).alias("at"), (a["on"] & (n - back > 0) & (F.get(inner, n - back) >= 0)).alias("on")), lambda a: a["at"])
    part = lambda first, many: F.array_join(F.slice(words, first + 1, F.greatest(many, F.lit(0))), " ")
    return F.when(n == 0, F.struct(F.lit("").alias("family"), F.lit("").alias("given"))).when(n == 1, F.struct(F.get(words, F.lit(0)).alias("family"), F.lit("").alias("given"))).otherwise(F.struct(part(cut, n - cut).alias("family"), part(F.lit(0), cut).alias("given")))


def first_author(names: Column) -> Column:
    """`Name et al.` of a list of names, `Name` of a single one; empty names don't count."""
    known = F.filter(names, lambda x: x.isNotNull() & (x != ""))
    return F.concat(F.coalesce(F.get(known, F.lit(0)), F.lit("")), F.when(F.size(known) > 1, " et al.").otherwise(""))


def cell(c: Column, most: int = 32_000) -> Column:
    """A spreadsheet cell: control characters out, longer texts cut, which a line says."""
    clean = F.regexp_replace(text_or_empty(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("\n[ ... truncated for Excel ... ]"))).otherwise(clean)


def csv_cell(c: Column) -> Column:
    """Several lines as one: each trimmed, empty ones out, joined by '; '."""
    return F.array_join(F.filter(F.transform(F.split(text_or_empty(c), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "; ")


def sentences(c: Column) -> Column:
    """Sentences of a text; a stop behind a usual abbreviation or inside a number ends none."""
    held = F.regexp_replace(text_or_empty(c), r"\b(et al|Fig|Eq|ref|vs|approx|cf|i\.e|e\.g|Dr|No)\.", "$1\u0001")
    parts = F.split(F.regexp_replace(held, r"(\d)\.(\d)", "$1\u0001$2"), r"(?<=[.!?])\s+(?=[A-Z(\[])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def sentence_at(c: Column, start: Column, end: Column) -> Column:
    """The span (from 0, end exclusive) widened to the sentence's bounds: a stop with its space, a line break, or the text's ends."""
    before, behind = F.substr(text_or_empty(c), F.lit(1), start), F.substr(text_or_empty(c), end + 1)
    head = F.length(F.regexp_extract(before, r"(?s)^(.*(?:[.!?] |\n))", 1))
    tail = F.length(F.regexp_extract(behind, r"(?s)^(.*?(?:[.!?] |\n))", 1))
    stop = F.when(tail > 0, end + tail).otherwise(F.length(c))
    return F.substr(c, head + 1, stop - head)


def publication_date(openalex: Column, year: Column, manager: Column) -> Column:
    """YYYY-MM-DD: the index's date, else its year, else the date of the manager's field, else a year in it; '' without any."""
    full = F.nullif(F.regexp_extract(text_or_empty(openalex), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    of_year = F.when(year.isNotNull() & (year > 0), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-01")))
    own = F.nullif(F.regexp_extract(text_or_empty(manager), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    loose = F.nullif(F.regexp_extract(text_or_empty(manager), r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    return F.coalesce(full, of_year, own, F.concat(loose, F.lit("-01-01")), F.lit(""))


def heading_date(c: Column) -> Column:
    """Date of a heading such as 03SEP2026; null for other text."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.regexp_extract(text_or_empty(c), r"(?i)\b(\d{2}[a-z]{3}\d{4})\b", 1)), F.lit("ddMMMyyyy")))


def added_at(values: Column) -> Column:
    """The latest of some stamps, as YYYY-MM-DD HH:MM:SS; empty ones don't count."""
    return F.array_max(F.filter(F.transform(values, lambda v: F.substring(F.replace(text_or_empty(v), F.lit("T"), F.lit(" ")), 1, 19)), lambda v: v != ""))


def since(now: Column, days: int) -> Column:
    """Start of a window of so many days before `now`."""
    return now - F.make_dt_interval(F.lit(days))


def manager_year(c: Column) -> Column:
    """A year of its own from 1600 to 2199."""
    return F.nullif(F.regexp_extract(text_or_empty(c), r"\b((?:1[6-9]|20|21)\d{2})\b", 1), F.lit("")).cast("int")


def reference_year(c: Column) -> Column:
    """A year of its own from 1500 to 2099, as reference lists have it."""
    return F.nullif(F.regexp_extract(text_or_empty(c), r"\b((?:1[5-9]|20)\d{2})\b", 1), F.lit("")).cast("int")


def haystack(title: Column, abstract: Column, body: Column | None = None) -> Column:
    """Lower-case title, abstract and body for substring search; the space after the title stays where the abstract is empty."""
    parts = [text_or_empty(title), text_or_empty(abstract)]
    return F.lower(F.concat_ws(" ", *parts, *([] if body is None else [F.nullif(body, F.lit(""))])))


def first_filled_engine(texts: Column, engines: list[str]) -> Column:
    """The first engine's text that is not empty, from a map of engine to text."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(texts, F.lit(e))), F.lit("")) for e in engines), F.lit(""))


def work_id(url: Column) -> Column:
    """Last part of a work's URL."""
    return F.element_at(F.split(F.regexp_replace(text_or_empty(url), "/+$", ""), "/"), -1)


def ordered_tags(tags: Column) -> Column:
    """Each tag once whatever its case, the first spelling, in order of the lower-case form."""
    low = F.transform(tags, F.lower)
    once = F.filter(tags, lambda t, i: (F.array_position(low, F.lower(t)) == i + 1) & (F.trim(t) != ""))
    return F.transform(F.array_sort(F.transform(once, lambda t: F.struct(F.lower(t).alias("k"), t.alias("t")))), lambda x: x["t"])


def fingerprint(values: Column, length: int = 40) -> Column:
    """SHA-1 of a set of strings in order, its first characters."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), "\n").cast("binary")), 1, length)


def in_config_order(found: Column, labels: list[str]) -> Column:
    """The labels found, in the order of the configuration."""
    return F.filter(F.array(*(F.lit(x) for x in labels)), lambda x: F.array_contains(found, x))


def json_path(c: Column, path: str, default: str = "") -> Column:
    """A value of a JSON text, or the default where any step of the path is missing."""
    return F.coalesce(F.get_json_object(c, "$." + path), F.lit(default))


def synthetic_key(doi: Column, key: Column, title: Column) -> Column:
    """The DOI, else `nodoi-` and the manager's key, else `ref-` and the title's slug."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(title)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.coalesce(normalize_doi(doi), F.concat(F.lit("nodoi-"), F.nullif(key, F.lit(""))), F.concat(F.lit("ref-"), slug))


def garbled(c: Column) -> Column:
    """Whether private-use, replacement or control characters take too large a share of a text, or letters too small a one."""
    n = F.length(c)
    bad = F.length(F.regexp_replace(c, r"[^\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.coalesce((n > 0) & ((bad > BAD_SHARE * n) | (letters < LETTER_SHARE * n)), F.lit(False))


def unspaced(c: Column) -> Column:
    """Whether the words of a text are so long that its spaces must be lost; fewer than LEAST_WORDS words tell nothing."""
    words = F.filter(F.split(F.trim(text_or_empty(c)), r"\s+"), lambda w: w != "")
    n, total = F.size(words), F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return (n >= LEAST_WORDS) & ((total > MEAN_WORD * n) | (F.size(F.filter(words, lambda w: F.length(w) > LONG_WORD)) > LONG_SHARE * n))


def text_layer_ok(c: Column) -> Column:
    """Whether a text layer can stand without recognition: short ones as plain labels, others neither garbled nor unspaced."""
    label = F.rlike(text_or_empty(c), F.lit(r"^[A-Za-z0-9 ().,:;\[\]\-–]*[A-Za-z0-9][A-Za-z0-9 ().,:;\[\]\-–]*$"))
    return F.when(F.length(text_or_empty(c)) < LEAST_TEXT, label).otherwise(~garbled(c) & ~unspaced(c))


def citation(names: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    """Author-year citation: up to two family names, or the first and et al.; parts that are missing are left out."""
    families = F.transform(F.filter(names, lambda n: text_or_empty(n) != ""), lambda n: split_name(n)["family"])
    who = F.when(F.size(families) > 2, F.concat(F.get(families, F.lit(0)), F.lit(" et al."))).otherwise(F.array_join(families, " & "))
    part = lambda c, tail: F.when(text_or_empty(c) != "", F.concat(c, F.lit(tail)))
    when = F.concat(F.lit("("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")."))
    return F.concat_ws(" ", F.nullif(who, F.lit("")), when, part(F.regexp_replace(title, r"\.+$", ""), "."), part(journal, "."), F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit(""))))


def caption_match(c: Column, strong: list[str], weak: list[str], least: int = 2) -> Column:
    """Whether a caption has a strong keyword, or `least` different weak ones, each as words of their own whatever their case."""
    has = lambda word: F.rlike(F.lower(text_or_empty(c)), F.lit(rf"(?<![\w-]){word.lower()}(?![\w-])"))
    any_strong = reduce(lambda a, w: a | has(w), strong, F.lit(False))
    return any_strong | (reduce(lambda a, w: a + has(w).cast("int"), weak, F.lit(0)) >= least)
