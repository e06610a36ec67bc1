r"""Text normalisation, template skeletons, distinctiveness and fingerprints.

All steps are built-in expressions but two that Spark lacks: Unicode compatibility normalisation and the rewriting of links
inside a text. Only texts that need these go to Python; the others get null there. \w is [\p{L}\p{N}_] everywhere.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish import config

# What a link looks like, emoji, and characters that have plain forms.
LINK = (
    r"((?:https?://|www\.)[^\s]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\."
    r"(?:com|net|org|io|ai|al|me|app|cfd|xyz|pro|info|co|ly|gg|tv|to|link|site|online|live)\b(?:/[^\s]*)?)"
)
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{20E3}]"
QUOTES_FROM, QUOTES_TO = "‘’“”–—", "''\"\"--"
_LINK = re.compile(LINK, re.I)
#: The same for Spark, where each repetition of a group takes a frame of the stack; a name has 127 labels at most.
_BOUNDED = LINK.replace(")*", "){0,126}", 1)
_TRACKING = re.compile(config.TEXT_TRACKING, re.I)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_PARTS = re.compile(r"(?:[a-z]+://)?(?:www\.)?([^/?#]*)([^?#]*)\??([^#]*)", re.I)


def plain_link(link: str) -> str:
    """A link without scheme, www., tracking parameters, fragment and closing slashes, in lower case."""
    host, path, query = _PARTS.match(link).groups()
    named = [tuple(map(unquote_plus, x.partition("=")[::2])) for x in query.split("&") if x]
    kept = "&".join("=".join(map(quote_plus, x)) for x in named if not _TRACKING.match(x[0]))
    return (host + path.rstrip("/") + ("?" + kept if kept else "")).lstrip("/").lower()


def _compatible(text: str | None) -> str | None:
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text)
    for a, b in zip(QUOTES_FROM, QUOTES_TO, strict=True):
        text = text.replace(a, b)
    return _LINK.sub(lambda m: f" {plain_link(m[0])} ", text.replace("…", "..."))


def compatible(text: Column) -> Column:
    """NFKC, plain quotes and rewritten links."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(_compatible, na_action="ignore")

    return F.pandas_udf(each, T.StringType())(text)


def needs_python(text: Column) -> Column:
    """Whether a text may hold a link or a character that isn't its own plain form; four cheap searches, of which each may find too much.

    Of a character in ASCII the first asks only whether it is below 0x7F, as most are.
    """
    odd = text.rlike(r"[\x7F-\x{10FFFF}&&[^\xA1-\xA7\xA9\xAB-\xAC\xAE\xB0-\xB1\xB6\xB7\xBB\xBF-\u017E]]")
    return odd | F.contains(text, F.lit("://")) | text.rlike(r"\.[A-Za-z]") | text.rlike(r"[wW]\.")


def normalized(text: Column, hard: Column | None = None) -> Column:
    """Compatible characters, links cleaned in place, no emoji, lower case, single spaces. Null becomes the empty text. hard: needs_python() of the text, where it is known."""
    text = F.coalesce(text, F.lit(""))
    hard = needs_python(text) if hard is None else hard
    done = F.when(hard, compatible(F.when(hard, text))).otherwise(text)
    bare = F.when(hard, F.regexp_replace(done, EMOJI, " ")).otherwise(done)
    return F.trim(F.regexp_replace(F.lower(bare), r"(?U)\s+", " "))


def emoji(text: Column) -> Column:
    """The text's emoji, one after another."""
    return F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({EMOJI})"), F.lit(1)), "")


def skeleton(norm: Column) -> Column:
    """The normalised text with wallets, contacts, links, names and numbers as placeholders, without other punctuation.

    Each kind is sought only in texts that hold what it can't do without.
    """
    s = F.when(F.contains(norm, F.lit("0x")), F.regexp_replace(norm, r"(?U)\b0x[a-f0-9]{16,}\b", " <wallet> ")).otherwise(norm)
    s = F.when(F.contains(norm, F.lit(".me/")), F.regexp_replace(s, r"(?U)\b(?:t\.me|wa\.me|telegram\.me)/\S+", " <contact> ")).otherwise(s)
    s = F.when(norm.rlike(r"(?iU)\.[a-z]|://|www\."), F.regexp_replace(s, "(?iU)" + _BOUNDED, " <url> ")).otherwise(s)
    s = F.when(F.contains(norm, F.lit("@")), F.regexp_replace(s, r"@[\p{L}\p{N}_]+", " <user> ")).otherwise(s)
    s = F.regexp_replace(s, r"[$€£]?\p{Nd}[\p{Nd},.]*(?U:\s*)(?:k|m|million|billion)?", " <num> ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_<> ]+", " ")
    return F.trim(F.regexp_replace(s, r" +", " "))


def plain_words(norm: Column) -> Column:
    """A normalised text without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm, r"[^\p{L}\p{N}_ ]+", " "), " +", " "))


def _distinct(plain: Column, template: Column) -> Column:
    said = sum((F.contains(plain, F.lit(p)).cast("int") for p in config.GENERIC_PHRASES if len(p) > 3), F.lit(0))
    extra = F.when(template.rlike("<(wallet|contact|url)>"), 15).otherwise(0) - 10 * said

    def of_tokens(tokens: Column) -> Column:
        counts = let(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*config.STOP_WORDS)), lambda c: 8 * F.size(F.array_distinct(c)) - 2 * F.size(c))
        score = F.least(F.lit(100), counts + 2 * F.size(tokens)) + extra
        return F.when(F.size(tokens) < 4, F.least(score, F.lit(20))).otherwise(score)

    score = let(F.split(plain, " "), of_tokens)
    return F.when((plain == "") | plain.isin(*config.GENERIC_PHRASES), 5).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("int")


def distinctiveness(norm: Column, template: Column | None = None) -> Column:
    """0 to 100: how far a normalised text is from what anyone might write."""
    return let(plain_words(norm), lambda plain: _distinct(plain, skeleton(norm) if template is None else template))


def band(score: Column) -> Column:
    return F.when(score < 30, "LOW").when(score < 60, "MEDIUM").otherwise("HIGH")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def fingerprints(rows, text: str = "text"):
    """Rows with norm, skeleton, exact_hash, norm_hash, template_id, distinctiveness and band of a text column; each step is computed once."""
    rows = rows.withColumn("_hard", needs_python(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("norm", normalized(F.col(text), F.col("_hard")))
    rows = rows.withColumns({"skeleton": skeleton(F.col("norm")), "_plain": plain_words(F.col("norm"))})
    rows = rows.withColumn("distinctiveness", _distinct(F.col("_plain"), F.col("skeleton"))).drop("_hard", "_plain")
    return rows.withColumns(
        {
            "exact_hash": short_hash(F.coalesce(F.col(text), F.lit(""))),
            "norm_hash": short_hash(F.col("norm")),
            "template_id": F.concat(F.lit("T-"), F.substring(F.sha2("skeleton", 256), 1, 12)),
            "band": band(F.col("distinctiveness")),
        }
    )


#: Texts of a group whose fingerprints its summary shows.
SHOWN = 25


def shown_fingerprints(rows, group: str = "source", order: str = "doc_id", text: str = "text"):
    """fingerprints() of the first SHOWN texts of each group, with their place; empty texts have none. Only the texts shown are normalised.

    Texts of one place in the order follow each other as texts.
    """
    places = Window.partitionBy(group).orderBy(F.asc_nulls_last(order), text)
    first = rows.where(F.col(text) != "").withColumn("place", F.row_number().over(places)).where(F.col("place") <= SHOWN)
    return fingerprints(first, text)


def shingles(norm: Column, k: int = 3, of=lambda run: run, kind: str = "string") -> Column:
    """The distinct runs of k words, or what `of` makes of them; a shorter text is one run, an empty one has none.

    A run is put together from single words, as a slice copies all words of the text for each run.
    """
    def runs(words: Column) -> Column:
        run = lambda i: of(F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), run)
        return F.when(F.size(words) > 0, F.array_distinct(every)).otherwise(F.array().cast(f"array<{kind}>"))

    return let(F.filter(F.split(norm, " "), lambda w: w != ""), runs)


def run_hashes(rows, text: str = "text", name: str = "runs"):
    """Rows with the 64-bit hashes of the distinct 3-word runs of a text column, normalised, in ascending order; each step is computed once."""
    rows = rows.withColumn("_hard", needs_python(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("_norm", normalized(F.col(text), F.col("_hard")))
    return rows.withColumn(name, F.sort_array(shingles(F.col("_norm"), of=F.xxhash64, kind="long"))).drop("_hard", "_norm")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets, to three places; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.bround(both / (F.size(a) + F.size(b) - both), 3))
