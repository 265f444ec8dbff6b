"""Document chunking and filtered retrieval.

* chunks: fixed 1000-character pieces of a document (characters, not bytes),
  blank pieces dropped; identity is ``(doc key, pos)`` — stable and
  computed per document, no global numbering pass.
* pages -> chunks without building the document string: each page's offset
  in the document comes from a two-level prefix sum (per block of pages, then
  within a block), so no task ever holds a whole large document; a chunk is
  assembled from at most 1000 characters of page pieces.
* filtered search: the allow-list before the cut (only allowed rows are scored)
  or after it; the searches of the whole index are in :mod:`vectorsearch` and
  :mod:`textsearch`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.stored import default_buckets

CHUNK_SIZE = 1000     # characters per chunk (fixed value)
SEARCH_LIMIT = 10     # hits taken from the whole index (fixed value)
RETURNED = 3          # hits kept after the allow-list filter (fixed value)
CONTEXT_SEP = "\n---\n"
FILES_SEP = ", "
PAGE_BLOCK = 1024     # pages per block of the two-level offset sum
LIST_PAGE = 100       # documents on one page of a plant's list
CELL_CHUNKS, CELL_PLANTS = 16384, 4096      # chunks and plants of a file that meet in one cell
MAX_CELL_TASKS = 10000
RUN = 256             # plants that follow each other for every chunk of a cell


# ----------------------------------------------------------------- chunking
def chunk_text(docs: DataFrame, key_cols: list[str], text_col: str = "text", size: int = CHUNK_SIZE) -> DataFrame:
    """One row per non-blank ``size``-character piece: ``key_cols + [pos, text]``.

    The pieces are cut in one left-to-right regex pass (``.{1,size}`` counts
    code points, like Python slicing) — per-chunk ``substring`` calls would
    rescan the text from its start for every chunk.  Only the piece array is
    exploded; the document text is not copied into every chunk row."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), 0)
    x = docs.select(*key_cols, F.posexplode(pieces).alias("pos", "text"))
    return x.filter(tx.has_content("text"))


def page_offsets(pages: DataFrame, file_col: str = "file", page_col: str = "page_no",
                 text_col: str = "text", block: int = PAGE_BLOCK) -> DataFrame:
    """Each page's segment (text + newline) and its start offset in the
    assembled document: ``file, page_no, seg, start, seg_len``.

    Offsets come from a two-level prefix sum: block totals (a partial
    aggregate), a running sum over a file's blocks, a running sum within a
    block.  The widest window partition holds one block of pages."""
    seg = F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"))
    p = pages.select(F.col(file_col).alias("file"), F.col(page_col).alias("page_no"), seg.alias("seg"))
    p = p.withColumn("seg_len", F.char_length("seg")).withColumn("blk", F.floor(F.col("page_no") / block))
    blocks = p.groupBy("file", "blk").agg(F.sum("seg_len").alias("blk_len"))
    wb = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "blk", F.coalesce(F.sum("blk_len").over(wb), F.lit(0)).alias("blk_start"))
    wp = Window.partitionBy("file", "blk").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("in_blk", F.coalesce(F.sum("seg_len").over(wp), F.lit(0)))
    # Null file names and null page numbers (which stand first) keep their pages.
    b = blocks.select(F.col("file").alias("b_file"), F.col("blk").alias("b_blk"), "blk_start")
    j = p.join(b, F.col("file").eqNullSafe(F.col("b_file")) & F.col("blk").eqNullSafe(F.col("b_blk")), "inner")
    return j.select("file", "page_no", "seg", (F.col("blk_start") + F.col("in_blk")).alias("start"), "seg_len")


def chunk_pages(pages: DataFrame, file_col: str = "file", page_col: str = "page_no", text_col: str = "text",
                size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of the assembled documents (page text + newline after each page,
    in page order), blank chunks dropped: ``file, pos, text``.

    Equals chunking the concatenated document, but each chunk is built from
    the page pieces that overlap it, grouped by ``(file, pos)``: a group has
    at most ``size`` characters however large the document."""
    o = page_offsets(pages, file_col, page_col, text_col)
    first = F.floor(F.col("start") / size).cast("long")
    last = F.floor((F.col("start") + F.col("seg_len") - 1) / size).cast("long")
    x = o.select("file", "seg", "start", "seg_len", F.explode(F.sequence(first, last)).alias("pos"))
    lo = F.greatest(F.col("pos") * size, F.col("start"))
    hi = F.least((F.col("pos") + 1) * size, F.col("start") + F.col("seg_len"))
    x = x.select("file", "pos", lo.alias("at"),
                 F.substring(F.col("seg"), (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    g = x.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("ps"))
    out = g.select("file", F.col("pos").cast("int").alias("pos"),
                   F.array_join(F.transform("ps", lambda s: s["piece"]), "").alias("text"))
    return out.filter(tx.has_content("text"))


def corpus_stats(chunks: DataFrame, file_col: str = "file") -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct(file_col).alias("n_files"))


def docs_by_group(refs: DataFrame) -> DataFrame:
    """Plant -> its documents (distinct, sorted) and their number."""
    d = refs.select("plant", "file").distinct()
    g = d.groupBy("plant").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return g.select("plant", F.size("files").cast("long").alias("n_files"),
                    F.array_join("files", FILES_SEP).alias("files"))


def docs_by_group_paged(refs: DataFrame, size: int = LIST_PAGE) -> DataFrame:
    """Plant -> its documents (distinct, sorted) in pages of ``size``:
    ``plant, page, n_files, files``, pages counted from 0.

    No row holds more than ``size`` documents and no task a whole plant: the
    list is dealt out in ranges of (plant, file) and numbered in two levels,
    each range's share of a plant and then the rows within it. Null files are
    on no page; null plants are one plant."""
    ensure_checkpoint_dir(refs.sparkSession)
    d = refs.where("file is not null").select("plant", "file").distinct()
    # written once, so that both levels see the same ranges
    d = d.repartitionByRange("plant", "file").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = d.groupBy("plant", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("plant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col("plant").alias("s_plant"), F.col("part").alias("s_part"), F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("plant", "part").orderBy("file")) - 1
    x = d.withColumn("own", own).join(starts, F.col("plant").eqNullSafe(F.col("s_plant")) & (F.col("part") == F.col("s_part")))
    x = x.withColumn("page", F.floor((F.col("start") + F.col("own")) / size).cast("long"))
    g = x.groupBy("plant", "page").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return g.select("plant", "page", F.size("files").cast("long").alias("n_files"), F.array_join("files", FILES_SEP).alias("files"))


def allowed(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Chunks each plant may read: an equi-join on the file.

    A file's chunks are dealt into parts and its plants into lists, and every
    part meets every list in a cell of its own, of about CELL_CHUNKS x CELL_PLANTS
    rows: no task holds a whole file's pairs, however few the files.  Only chunks
    and lists are shuffled; the pairs are made where they go out.  They go out a
    run of RUN plants at a time, the same run for every chunk of the cell, so that
    a columnar file stores a chunk once a run and the run's plants as repeats."""
    spark = chunks.sparkSession
    base = scratch_path(spark, "allowed")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    # Numbered once, so that copies of a row go to different parts, and again to the same if a task is repeated.
    c = written(chunks.where("file is not null").withColumn("_n", F.monotonically_increasing_id()), "chunks")
    r = refs.where("file is not null").groupBy("plant", "file").agg(F.count(F.lit(1)).alias("_n"))
    r = written(r.select("file", "plant", F.explode(F.sequence(F.lit(1), "_n")).alias("_n")), "refs")
    parts = c.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / CELL_CHUNKS).alias("_parts"))
    sizes = written(parts.join(r.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / CELL_PLANTS).alias("_lists")), "file"), "sizes")
    n = max(default_buckets(spark), min(MAX_CELL_TASKS, sizes.agg(F.sum(F.col("_parts") * F.col("_lists"))).first()[0] or 1))
    key, upto = ["file", "_part", "_list"], lambda col: F.explode(F.sequence(F.lit(0), F.col(col).cast("int") - 1))
    c = c.join(sizes, "file").withColumn("_part", F.pmod(F.xxhash64("_n"), "_parts").cast("int")).withColumn("_list", upto("_lists"))
    r = r.join(sizes, "file").withColumn("_list", F.pmod(F.xxhash64("plant", "_n"), "_lists").cast("int"))
    lists = r.groupBy("file", "_list", "_parts").agg(F.collect_list(F.struct("plant")).alias("_plants"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_plants"), F.lit(RUN)), lambda at: F.slice("_plants", at, RUN))
    lists = lists.withColumn("_plants", F.explode(runs)).withColumn("_part", upto("_parts"))
    # A number of partitions of our own: Spark would merge cells by what they read, not by what they give.
    # The chunks are the hashed side: a run passes over all chunks of its cell before the next one.
    x = c.drop("_n", "_parts", "_lists").repartition(n, *key).hint("shuffle_hash").join(lists.drop("_parts").repartition(n, *key), key)
    return x.select(*chunks.columns, F.explode("_plants").alias("_p")).select("file", *[c for c in chunks.columns if c != "file"], "_p.plant")


# ----------------------------------------------------------------- vector search
def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group, element by element (a partial aggregate per
    (group, dimension); the regrouped array has one entry per dimension)."""
    x = vectors.select(group_col, F.posexplode(vec_col).alias("d", "v"))
    m = x.groupBy(group_col, "d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    g = m.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("dv"))
    return g.select(group_col, F.transform("dv", lambda s: s["v"]).alias("qvec"))


def _cosine():
    return F.when((F.col("nv") > 0) & (F.col("nq") > 0), vx.dot("v", "q") / (F.col("nv") * F.col("nq")))


def score_allowed(corpus: DataFrame, queries: DataFrame, refs: DataFrame, id_col: str = "vec_id",
                  vec_col: str = "embedding") -> DataFrame:
    """Cosine of each query against the corpus rows its plant may see, and no
    others: queries meet the allow-list on the plant, then the corpus on the file."""
    c = corpus.select(id_col, "file", vx.as_double(vec_col).alias("v")).withColumn("nv", vx.norm("v"))
    q = queries.select("query_id", "plant", vx.as_double("qvec").alias("q")).withColumn("nq", vx.norm("q"))
    j = q.join(refs.select("plant", "file").distinct(), "plant").join(c, "file")
    return j.select("query_id", id_col, "file", _cosine().alias("score"))


def top_k(scored: DataFrame, k: int, id_cols: list[str], score_col: str = "score",
          part_col: str = "query_id") -> DataFrame:
    """Rank per query by score (desc; ties by id asc), keep ranks <= k.

    Ranking uses the score rounded to 9 places so that equal scores computed
    in a different summation order tie and fall back to the id."""
    w = Window.partitionBy(part_col).orderBy(F.round(F.col(score_col), 9).desc_nulls_last(), *[F.col(c) for c in id_cols])
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def post_filter(hits: DataFrame, refs: DataFrame, keep: int = RETURNED, id_cols: list[str] | None = None) -> DataFrame:
    """Top-k hits of the whole index filtered by the query plant's allowed
    files, then the first ``keep`` in rank order (possibly fewer, or none)."""
    r = refs.select(F.col("plant"), F.col("file"))
    a = hits.join(r, ["plant", "file"], "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank")
    return a.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def search_status(queries: DataFrame, refs: DataFrame, top: DataFrame, kept: DataFrame,
                  corpus_rows: int) -> DataFrame:
    """One status per query: ``empty_index``, ``no_allowed_files``,
    ``no_hit``, ``no_allowed_hit`` or ``ok`` (with the number kept)."""
    n_allowed = refs.groupBy("plant").agg(F.count(F.lit(1)).alias("n_allowed"))
    n_top = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_top"))
    n_kept = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_kept"))
    j = queries.select("query_id", "plant").join(n_allowed, "plant", "left") \
        .join(n_top, "query_id", "left").join(n_kept, "query_id", "left")
    status = (F.when(F.coalesce("n_allowed", F.lit(0)) == 0, "no_allowed_files")
              .when(F.lit(corpus_rows) == 0, "empty_index")
              .when(F.coalesce("n_top", F.lit(0)) == 0, "no_hit")
              .when(F.coalesce("n_kept", F.lit(0)) == 0, "no_allowed_hit")
              .otherwise("ok"))
    return j.select("query_id", "plant", status.alias("status"),
                    F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_returned"))


# ----------------------------------------------------------------- answers
def context_block(hits: DataFrame, text_col: str = "text", file_col: str = "file") -> DataFrame:
    """Per query: chunk texts joined by ``\\n---\\n`` and the consulted files
    (duplicates kept), both in rank order (at most RETURNED per query)."""
    g = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col(text_col).alias("t"), F.col(file_col).alias("f")))).alias("hs"))
    return g.select(
        "query_id",
        F.array_join(F.transform("hs", lambda h: h["t"]), CONTEXT_SEP).alias("context"),
        F.array_join(F.transform("hs", lambda h: h["f"]), FILES_SEP).alias("files"),
        F.size("hs").cast("long").alias("n_hits"),
    )
