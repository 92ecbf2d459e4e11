"""Near-duplicate removal with operator 3: SimHash components, verified by word shingles; one document of each group stays.

1. Texts of one set of five-word shingles (letter case A-Z and white space aside) are one.
2. The sets' fingerprints over distinct words are linked by operator 3's covering LSH at RADIUS bits: a similarity of 0.8
   over five-word shingles leaves nearly all words in common, which moves few of these bits. Each set is compared with the
   first of its component; those at THRESHOLD or more are joined.
3. Every pair at THRESHOLD or more that is not yet in one class is found by operator 13's forest of signature trees and
   compared, so neither the radius nor the first of a component loses a link.
Of each class the smallest doc_id stays. One pass over the texts gives fingerprints, bitmaps and prefixes; after it
only texts that are compared move, and a task holds one set and streams its partners.

Defined results: null and empty texts are equal to each other; rows of one doc_id stay or go together; null ids come last;
an empty table gives an empty result; all columns of docs are given back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import cut, free_name
from quillspark.llm.signature_join import BLOCK, jaccard_sets

RADIUS, SHINGLE, THRESHOLD, CHUNK = 5, 5, 0.8, BLOCK


def near_dedup(docs: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs that stay. chunk: sets of a tree."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, roots = jaccard_sets(plain, SHINGLE, round(100 * threshold), block=chunk, radius=radius)
    classes = sets.select("doc_id", "digest", "n").join(roots.select(F.col("digest").alias("_d"), "root"), F.col("digest") == F.col("_d"), "left").select("doc_id", "root")  # texts without words have no root
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    stays = classes.groupBy("root").agg(first.alias("m")).select(F.col("m.doc_id").alias("_stay")).distinct()
    own = free_name("_gone", docs.columns)
    gone = cut(sets.select("doc_id").distinct().join(stays, F.col("doc_id").eqNullSafe(F.col("_stay")), "left_anti").select(F.col("doc_id").alias(own)), "near-gone")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_anti")
