"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


#: Longer texts are not learned from, so that a sample's bytes are bounded as well.
LONGEST = 1 << 18


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; rows without an id are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def labelled(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, id_column: str = "doc_id", text_column: str = "text", extra: str | None = None) -> list[tuple]:
    """About ``rows`` texts with their labels, at most 1.1 times as many, half of each class as far as there are, none of the fold held out.

    Rows are (text, label), or (text, extra, label). Which ones follows from a hash of their ids alone, so that reruns
    learn from the same ones. Texts are whole, of LONGEST bytes at most. Labels that are null or contradict each other
    are left out.
    """
    return weighted(documents, labels, label, folds, held_out, rows, id_column, text_column, extra)[0]


def weighted(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, id_column: str = "doc_id", text_column: str = "text", extra: str | None = None) -> tuple[list[tuple], dict[int, float]]:
    """The rows of ``labelled``, and by label how many labelled rows each of its rows stands for."""
    id_of = F.col(id_column).cast("long")
    clean = labels.select(id_of.alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    clean = clean.where(fold(F.col("id"), folds) != held_out).select("id", "label", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("draw"))
    counts = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = min((n for n in counts.values()), default=0)
    quota = {k: max(rows // 2, rows - few) if n > rows // 2 else n for k, n in counts.items()}
    wanted, stands_for = F.lit(False), {}
    for k, n in counts.items():
        below = int((1 << 20) * min(1.0, quota[k] / n))
        wanted = wanted | ((F.col("label") == k) & (F.col("draw") < below))
        stands_for[k] = (1 << 20) / max(below, 1)
    most = rows + rows // 10
    chosen = clean.where(wanted).orderBy("draw", "id").limit(most).select("id", "label", "draw")
    more = [extra] if extra else []
    texts = documents.select(id_of.alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), *more).where(F.octet_length("text") <= LONGEST)
    # chosen has at most 1.1 x rows rows of three numbers
    found = texts.join(F.broadcast(chosen), "id").orderBy("draw", "id", "text", *more).limit(most).select("id", "text", *more, "label").toPandas()
    found = found.sort_values(["id", "text"], kind="stable")
    return list(zip(*(found[c].tolist() for c in ("text", *more, "label")), strict=True)), stands_for
