"""Text functions as Columns: normal forms, hashes, chunks, tokens, trigrams, identifiers, triplets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that a lexical query drops.
STOP_WORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "but", "nor",
    "is", "are", "was", "were", "be", "been", "being", "am",
    "do", "does", "did", "doing",
    "has", "have", "had", "having",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
    "my", "your", "his", "its", "our", "their",
    "this", "that", "these", "those",
    "who", "whom", "whose", "which", "what", "when", "where", "why", "how",
    "with", "by", "from", "as", "into", "onto", "about", "than", "then",
    "if", "so", "not", "no", "yes", "can", "could", "will", "would", "shall", "should",
    "may", "might", "must", "there", "here",
)

# Fixed value: relations that the provider-free triplet extractor knows.
PREDICATES = ("depends_on", "owned_by", "caused", "deployed", "uses", "runs_on", "has_runbook")

#: Tokens of the lexical index and of queries: they keep hyphens, underscores and dots inside.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-_.]*"
#: Tokens with a separator inside, which name one thing exactly.
IDENTIFIER = r"\b[A-Za-z0-9]+(?:[-_.][A-Za-z0-9]+)+\b"
_NAME = r"[A-Z][\p{L}\p{N}_-]*(?:\s+[A-Z][\p{L}\p{N}_-]*)*"
TRIPLET = rf"({_NAME})\s+({'|'.join(PREDICATES)})\s+({_NAME})"

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 100


def normalize(x: Column) -> Column:
    """White space collapsed and trimmed, case kept."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def content_hash(x: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lower-case hex."""
    return F.sha2(x, 256)


def chunks(x: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Slices of ``size`` code points, each beginning ``size - overlap`` after the last; none of an empty text."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and the overlap smaller than it")
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.ceil(F.length(x) / stride).cast("int") - 1)
    return F.when(F.length(x) > 0, F.transform(starts, lambda k: F.substring(x, k * stride + 1, F.lit(size))))


def tokens(x: Column) -> Column:
    """Lexical tokens in order, lower-cased."""
    return F.transform(F.regexp_extract_all(x, F.lit(f"({TOKEN})"), 1), F.lower)


def query_terms(question: str) -> list[str]:
    """Distinct tokens of a question, lower-cased, without stop words; all of them where nothing else is left."""
    every = list(dict.fromkeys(w.lower() for w in re.findall(TOKEN, question)))
    return [w for w in every if w not in STOP_WORDS] or every


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, cut)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram arrays."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def anchors(x: Column) -> Column:
    """Identifiers with separators, lower-cased, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(f"({IDENTIFIER})"), 1), F.lower))


def loosened(x: Column) -> Column:
    """Lower case, runs of separators as spaces: the form in which identifiers are looked for."""
    return F.regexp_replace(F.lower(x), "[-_.]+", " ")


def words(x: Column) -> Column:
    """The tokens of the hashed bag of words: runs of letters, digits, underscores and hyphens, lower-cased."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_-]+)"), 1)


def feature_slot(token: Column, width: int) -> Column:
    """Slot and sign of a token, from its digest."""
    digest = F.sha2(token, 256)
    index = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % width
    odd = F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1
    return F.struct(index.cast("int").alias("slot"), F.when(odd, 1.0).otherwise(-1.0).alias("sign"))


def feature_slots(x: Column, width: int) -> Column:
    """Slot and sign of each token: the hashed bag of words behind the provider-free embedding."""
    return F.transform(words(x), lambda t: feature_slot(t, width))


def embedding(x: Column, width: int) -> Column:
    """The provider-free embedding: signed counts by slot, of unit length; zeros without tokens."""

    def unit(sums: Column) -> Column:
        norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, v: a + v * v))
        return F.transform(sums, lambda v: F.when(norm > 0, v / norm).otherwise(v))

    def summed(slots: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.filter(slots, lambda s: s["slot"] == i), F.lit(0.0), lambda a, s: a + s["sign"]))

    # Bound one after the other, so that no slot hashes the tokens again.
    sums = F.transform(F.array(feature_slots(x, width)), summed)
    return F.transform(sums, unit)[0]


def triplets(x: Column) -> Column:
    """Subject, predicate, object wherever two capitalised names stand about a known relation."""
    part = lambda g: F.regexp_extract_all(x, F.lit(TRIPLET), g)
    return F.transform(F.arrays_zip(part(1).alias("s"), part(2).alias("p"), part(3).alias("o")), lambda t: F.struct(F.trim(t["s"]).alias("subject"), t["p"].alias("predicate"), F.trim(t["o"]).alias("object")))


def estimated_tokens(x: Column) -> Column:
    """A quarter of the code points, rounded up, and one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor((F.length(x) + 3) / 4))


def citation(source: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit("#"), ordinal.cast("string"), F.lit("]"))
