"""Column functions on ordered step sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(tokens: Column) -> Column:
    """Removes repeats (A A) and interruptions (A B A) in one fold from the left.

    The two rewrite rules are confluent, so keeping the reduced sequence as a stack gives the same
    result as applying them until nothing changes.
    """
    kind = "array<string>"

    def step(stack: Column, token: Column) -> Column:
        n = F.size(stack)
        same = F.coalesce(F.get(stack, n - 1) == token, F.lit(False))
        back = F.coalesce(F.get(stack, n - 2) == token, F.lit(False))
        return F.when(same, stack).when(back, F.slice(stack, 1, n - 1)).otherwise(F.concat(stack, F.array(token)))

    return F.aggregate(tokens, F.array().cast(kind), step)


def signature_hash(signature: Column) -> Column:
    return F.substring(F.sha1(F.array_join(signature, "|").cast("binary")), 1, 16)


def signature_text(signature: Column) -> Column:
    return F.array_join(signature, " -> ")


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: First private code point of the two planes that stand for tokens, and how many they have.
FIRST_POINT, POINTS = 0xF0000, 0x1FFFE


def encoded(signature: Column, alphabet: Column) -> Column:
    """One character for each token (its position in ``alphabet``), so that edit distance counts tokens; raises above ``POINTS`` tokens."""
    fits = F.assert_true(F.size(alphabet) <= POINTS, F.lit(f"more than {POINTS} step tokens"))
    text = F.array_join(F.transform(signature, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(alphabet, t) + (FIRST_POINT - 1)), 8, "0")), "UTF-32")), "")
    return F.when(fits.isNull(), text)


def sequence_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two encoded sequences."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def entropy(counts: Column) -> Column:
    """Shannon entropy of an array of counts over its maximum; 0 for one or no class."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    bits = F.aggregate(counts, F.lit(0.0), lambda s, c: s - c / total * F.log2(c / total))
    return F.when(F.size(counts) <= 1, F.lit(0.0)).otherwise(bits / F.log2(F.size(counts).cast("double")))
