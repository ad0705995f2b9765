"""Identity and text functions, all inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that no decomposition reaches, and what they fold to.
LETTERS = (("ø", "o"), ("Ø", "o"), ("æ", "ae"), ("Æ", "ae"), ("œ", "oe"), ("Œ", "oe"), ("ß", "ss"), ("đ", "d"), ("Đ", "d"), ("ð", "d"), ("Ð", "d"), ("ł", "l"), ("Ł", "l"), ("þ", "th"), ("Þ", "th"), ("ı", "i"))
#: Last parts of a publisher's path behind a DOI.
DOI_VIEWS = "figures?|tables?|abstract|full|epdf|pdf|fullpdf|references?|metrics|supplementary|suppl|media"


def _decomposed() -> tuple[dict[str, str], str]:
    """Letters of the Latin blocks and compatibility forms by their plain letter or digit, and those that decompose to a letter and marks."""
    plain, marked = {}, []
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0x2100, 0x2190), *range(0xFF10, 0xFF5B)):
        parts = unicodedata.normalize("NFKD", chr(code))
        bare = "".join(c for c in parts if not unicodedata.combining(c))
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            plain[chr(code)] = bare
            if len(parts) > 1:
                marked.append(chr(code))
    return plain, "".join(marked)


_PLAIN, MARKED = _decomposed()
ACCENTED, PLAIN = "".join(_PLAIN), "".join(_PLAIN.values())
#: Compatibility forms of several letters or digits, from the same rule; those with marks are few.
_WHOLE = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in (*range(0x132, 0x1F4), *range(0x2100, 0x2190), *range(0xFB00, 0xFB07))}
_JOINED = {c: "".join(x for x in p if not unicodedata.combining(x)) for c, p in _WHOLE.items()}
_JOINED = {c: p for c, p in _JOINED.items() if len(p) > 1 and p.isascii() and p.isalnum()}


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _letters(c: Column) -> Column:
    """Accented and joined letters as plain ones, marks that stand alone dropped; texts in ASCII pass by."""
    folded = F.translate(c, ACCENTED, PLAIN)
    for letter, plain in (*LETTERS, *_JOINED.items()):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7f]")), F.regexp_replace(folded, r"[\u0300-\u036f]", "")).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Search form: letters folded, lower case, anything else one space."""
    return F.trim(F.regexp_replace(F.lower(_letters(text_or_empty(c))), "[^a-z0-9]+", " "))


def normalize_title(c: Column) -> Column:
    """Title identity: letters decomposed, lower case, anything else one space, marks included, so that an accent parts a word."""
    c = text_or_empty(c)
    apart = F.translate(F.regexp_replace(c, f"([{MARKED}])", "$1 "), ACCENTED, PLAIN)
    for letter, plain in _JOINED.items():
        apart = F.replace(apart, F.lit(letter), F.lit(plain + " " * (len(_WHOLE[letter]) > len(plain))))
    apart = F.when(F.rlike(c, F.lit(r"[^\x00-\x7f]")), apart).otherwise(c)
    return F.trim(F.regexp_replace(F.lower(apart), "[^a-z0-9]+", " "))


def search_title(c: Column) -> Column:
    """A title without the characters that a search service reads as operators; typographic quotes made plain."""
    quotes = F.translate(text_or_empty(c), "\u201c\u201d\u2018\u2019", "\"\"''")
    return collapse(F.regexp_replace(quotes, r"[|(){}\[\]^~?:\\/]", " "))


def fold_text(c: Column) -> Column:
    """Filter-box form: the search form without spaces."""
    return F.replace(normalize_text(c), F.lit(" "), F.lit(""))


def normalize_plain(c: Column) -> Column:
    """Lower case, other characters become spaces, no letter folding."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "))


def normalize_doi(c: Column) -> Column:
    """The DOI in a string without resolver prefix, view suffix and closing punctuation; null if there is none. Case stays."""
    found = F.regexp_extract(text_or_empty(c), r"(10\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+)", 1)
    bare = F.regexp_replace(found, f"(?i)/({DOI_VIEWS})(/.*)?$", "")
    return F.nullif(F.regexp_replace(bare, r"[./;:)]+$", ""), F.lit(""))


def link_key(c: Column) -> Column:
    """Canonical form of a URL: lower case, no scheme, www. or closing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), "^https?://", ""), r"^www\.", ""), "/+$", "")


def slug(c: Column, length: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)


def year_in(c: Column) -> Column:
    """The first year from 1900 to 2099 in free text."""
    return F.nullif(F.regexp_extract(text_or_empty(c), "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def crude_stem(c: Column) -> Column:
    """Each word of more than three characters without a closing s that is not ss; white space collapsed."""
    return F.regexp_replace(collapse(c), r"(?<=^| )([^ ]{2,}[^s ])s(?= |$)", "$1")


def clip_middle(c: Column, limit: int, mark: str = " ... ") -> Column:
    """Longer texts keep the first 60 and the last 40 percent of the limit."""
    head, tail = int(limit * 0.6), limit - int(limit * 0.6)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(mark), F.substring(c, -tail, tail)))


def words_from_positions(index: Column) -> Column:
    """Text of an inverted index (map of word to positions): words by position, then by word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def tags_match(have: Column, want: list[str], how: str) -> Column:
    """Any, all or none of the wanted tags, whatever their case; nothing wanted matches."""
    own, asked = F.transform(have, F.lower), F.array(*(F.lit(w.lower()) for w in want))
    if not want:
        return F.lit(True)
    if how == "all":
        return F.size(F.array_except(asked, own)) == 0
    return F.arrays_overlap(own, asked) if how == "any" else ~F.arrays_overlap(own, asked)


def plausible(value: Column, low: float, high: float) -> Column:
    """Whether every number in the value lies in the range; a value without numbers passes."""
    return F.forall(F.regexp_extract_all(text_or_empty(value), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double").between(low, high))


def positions_of_words(words: Column) -> Column:
    """Inverted index of an array of words: a map of word to its positions, from 0."""
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.transform(F.filter(at, lambda p: p["w"] == w), lambda p: p["i"]))))


def accessions(text: Column, urls: Column) -> Column:
    """Data set numbers (ds and six digits) in a text, each once, without those that a URL already holds."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"\bds\d{6}\b"), F.lit(0)))
    return F.filter(found, lambda a: ~F.exists(urls, lambda u: F.contains(F.lower(u), a)))


def repository(url: Column, host: str, reserved: tuple[str, ...] = ()) -> Column:
    """owner/name of a repository URL on the host, lower case; null without both or where the owner is a reserved word."""
    key = F.regexp_replace(link_key(url), "[?#].*$", "")
    owner, name = F.split_part(key, F.lit("/"), F.lit(2)), F.regexp_replace(F.split_part(key, F.lit("/"), F.lit(3)), r"\.git$", "")
    fits = (F.split_part(key, F.lit("/"), F.lit(1)) == host) & (owner != "") & (name != "")
    return F.when(fits & ~owner.isin(*reserved) if reserved else fits, F.concat_ws("/", owner, name))
