"""Text expressions: terms, search predicates, labels and snippets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are never terms.
STOPWORDS = tuple(
    """the and for you that this with are have will was but not all can just our your their they them
    what when where which who how about from into over then than there these those been being also its
    let get got one two out now new any more most some such only very much many each other here like
    make made need use used using via per yes okay thanks thank please would could should might must may
    did does doing done has had his her him she our ours were don isn aren didn doesn won wasn haven
    hasn couldn wouldn shouldn ill ive youre theyre thats theres whats lets its itself myself yourself
    https http www com org net html""".split()
)
#: A token, and a coined word.
TOKEN = "[a-z][a-z0-9_-]{2,}"
COINED = "[a-z]+(-[a-z]+)*"


def tokens(text: Column) -> Column:
    """All tokens of the lower-cased text, in order (index 0 asks for the whole match)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def terms(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per row and distinct term: tokens and pairs of neighbours, without stopwords in either half.  Words are dropped within
    the array, by a hashed lookup, so that only terms become rows."""
    listed = df.select(*keep, tokens(F.col(text)).alias("_t"))
    fine = lambda w: ~w.isin(*STOPWORDS)
    pair = lambda w, i: F.when((i > 0) & fine(w) & fine(F.get(F.col("_t"), i - 1)), F.concat_ws(" ", F.get(F.col("_t"), i - 1), w))
    found = F.concat(F.filter("_t", fine), F.array_compact(F.transform("_t", pair)))
    return listed.select(*keep, F.explode(F.array_distinct(found)).alias("term"))


def like_literal(query: str) -> str:
    """``query`` as a LIKE pattern that matches it anywhere, literally."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", query) + "%"


def matches(text: Column, query: str, how: str = "phrase") -> Column:
    """Case-insensitive search: the phrase, all of its words, or a regular expression."""
    if how == "phrase":
        return text.ilike(like_literal(query))
    if how == "all":
        return reduce(lambda a, b: a & b, [text.ilike(like_literal(w)) for w in query.split()] or [F.lit(True)])
    if how == "regex":
        return text.rlike("(?i)" + query)
    raise ValueError(f"unknown kind of search: {how!r}")


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, with a marker telling how many were left out."""
    over = F.length(text) - limit
    return F.when(over > 0, F.concat(F.substring(text, 1, limit), F.lit(" …[+"), over.cast("string"), F.lit(" chars]"))).otherwise(text)


def snippet(text: Column, query: str, limit: int = 200) -> Column:
    """``limit`` characters around the first occurrence of ``query`` (else the beginning), cut ends marked."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(F.lit(1), F.when(at > 0, at - (limit - len(query)) // 2).otherwise(F.lit(1)))
    body = F.substring(text, start, F.lit(limit))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + limit - 1 < F.length(text), "…").otherwise(""))


def safe_label(text: Column, limit: int = 80) -> Column:
    """One line without invisible characters, markdown or tags, of at most ``limit`` characters."""
    out = F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]+", " ")
    out = F.regexp_replace(out, r"[`*_\[\]#|~]", "")
    out = F.translate(out, "<>", "‹›")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit - 1), F.lit("…"))).otherwise(out)


def name_key(name: Column) -> Column:
    """A name for comparison: lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def words_of_identifier(name: Column) -> Column:
    """The lower-cased words of a camelCase, snake_case or dotted identifier."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Runs of letters a-z and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")


def shingle_hashes(words: str, width: int = 6) -> Column:
    """A 64-bit hash of each run of ``width`` words.  ``words`` must be a column of its own: an expression would be
    evaluated anew for every shingle.  Each word is hashed once; a shingle folds the hashes of its words."""
    return F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(*[F.get(F.col(words), i - 1 + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes."""
    octets = F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    # The prime is 2**24 + 403, so that the product stays within 64 bits and the part beyond 32 falls away.
    low = lambda x, bits: x.bitwiseAND(F.lit(bits))

    def step(acc: Column, octet: Column) -> Column:
        x = acc.bitwiseXOR(F.conv(octet, 16, 10).cast("bigint"))
        return low(low(x * 403, 0xFFFFFFFF) + F.shiftleft(low(x, 0xFF), 24), 0xFFFFFFFF)

    return F.aggregate(octets, F.lit(2166136261).cast("bigint"), step)


def fenced(text: Column, nonce: str) -> Column:
    """Untrusted text between marks that carry a nonce of the request; anything in it that looks like such a mark or a tag is made harmless."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<(?=[/!?A-Za-z])", "‹"), "(?i)untrusted-", "untrusted‐")
    return F.concat(F.lit(f"<untrusted-{nonce}>\n"), safe, F.lit(f"\n</untrusted-{nonce}>"))
