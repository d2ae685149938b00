"""Training-set preparation: path columns, labels, input/target pairs, seeded shuffle, splits, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import global_rank

# Fixed values that must equal the reference behaviour.
EVAL_SPLIT = 0.01     # share of shuffled files that go to evaluation
SEED = 31             # seed for shuffling
BATCH_SIZE = 8


def path_columns(df: DataFrame, path: str = "path") -> DataFrame:
    """ext = after the last '.', stem = path without '.ext', label = basename before '_' + '.' + ext."""
    p = F.col(path)
    ext = F.substring_index(p, ".", -1)
    base = F.substring_index(p, "/", -1)
    stem = F.expr(f"substring({path}, 1, length({path}) - length(substring_index({path}, '.', -1)) - 1)")
    label = F.concat(F.split(base, "_").getItem(0), F.lit("."), ext)
    return df.withColumn("ext", ext).withColumn("stem", stem).withColumn("label", label)


def label_ids(files: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels with dense ids 0..L-1 in label order (deterministic, unlike first-seen order)."""
    d = files.select(label).distinct()
    return global_rank(d, [label], out="label_id")


def label_join(files: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    from tessera.plans.hints import bounded_broadcast
    return files.join(bounded_broadcast(labels), label)


def pairs_unidirectional(files: DataFrame, input_ext: str, target_ext: str) -> DataFrame:
    """(input_path, target_path) for every input file whose stem also exists with the target extension."""
    i = files.filter(F.col("ext") == input_ext).select("stem", F.col("path").alias("input_path"))
    t = files.filter(F.col("ext") == target_ext).select("stem", F.col("path").alias("target_path"))
    return i.join(t, "stem").select("input_path", "target_path")


def pairs_bidirectional(files: DataFrame, input_ext: str, target_ext: str) -> DataFrame:
    """Both directions: an existing pair is found from each side, so it is emitted twice (input, target)."""
    fwd = pairs_unidirectional(files, input_ext, target_ext)
    back = files.filter(F.col("ext") == target_ext).select("stem", F.col("path").alias("target_path")).join(
        files.filter(F.col("ext") == input_ext).select("stem", F.col("path").alias("input_path")), "stem"
    ).select("input_path", "target_path")
    return fwd.unionByName(back)


def seeded_key(id_col: str, seed: int = SEED) -> Column:
    """Reproducible shuffle key: md5 of seed and id (same on any engine)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    return global_rank(df.withColumn("_key", seeded_key(id_col, seed)), ["_key", id_col], out="shuffle_rank").drop("_key")


def train_eval_split(df: DataFrame, id_col: str, share: float = EVAL_SPLIT, seed: int = SEED) -> DataFrame:
    """First int(n*share) files of the seeded shuffle go to 'eval', the rest to 'train'."""
    s = seeded_shuffle(df, id_col, seed)
    n_eval = F.floor(df.select(F.count(F.lit(1)) * share).scalar())
    return s.withColumn("split", F.when(F.col("shuffle_rank") < n_eval, "eval").otherwise("train"))


def drop_remainder(ranked: DataFrame, rank: str, batch: int = BATCH_SIZE) -> DataFrame:
    """Keep floor(n/batch)*batch rows (ranks 0-based)."""
    n = ranked.select(F.count(F.lit(1))).scalar()
    return ranked.filter(F.col(rank) < n - n % batch)


def minibatch(ranked: DataFrame, rank: str, size: int = BATCH_SIZE) -> DataFrame:
    return ranked.withColumn("batch_no", F.floor(F.col(rank) / size).cast("long"))


def window_bounds(files: DataFrame, id_col: str, n_patches: str = "n_patches", max_patches: int = 1024, seed: int = SEED) -> DataFrame:
    """Training window of each file: the whole, or by a seeded draw its head, body or tail of
    ``max_patches`` patches (choice, start_patch, kept_patches)."""
    draw = F.md5(F.concat(F.lit(f"{seed}:trunc:"), F.col(id_col).cast("string")))
    u32 = lambda k: F.conv(F.substring(draw, 1 + 8 * k, 8), 16, 10).cast("long")
    n, c = F.col(n_patches), u32(0) % 3
    x = files.withColumn("choice", F.when(n <= max_patches, "whole").when(c == 0, "head")
                         .when((c == 1) & (n > max_patches + 1), "body").otherwise("tail"))
    start = (F.when(F.col("choice").isin("whole", "head"), 0)
             .when(F.col("choice") == "body", 1 + u32(1) % (n - max_patches)).otherwise(n - max_patches))
    return x.withColumn("start_patch", start.cast("int")).withColumn("kept_patches", F.least(n, F.lit(max_patches)).cast("int"))


def truncate_windows(patches: DataFrame, id_col: str, max_patches: int = 1024, seed: int = SEED) -> DataFrame:
    """The patches of each file that lie in its training window."""
    sizes = patches.groupBy(id_col).agg((F.max("patch_no") + 1).alias("n_patches"))
    w = window_bounds(sizes, id_col, "n_patches", max_patches, seed).select(id_col, "start_patch", "kept_patches")
    at = F.col("patch_no") - F.col("start_patch")
    return patches.join(w, id_col).filter((at >= 0) & (at < F.col("kept_patches"))).drop("start_patch", "kept_patches")


def pad_batches(ranked: DataFrame, rank: str, symbols: str, batch: int = BATCH_SIZE, patch: int = 16, pad: int = 256) -> DataFrame:
    """Minibatches padded to their longest sequence: batch_no, padded (array<int>) and mask (one
    flag a patch: 1 data, 0 padding)."""
    b = minibatch(ranked, rank, batch)
    longest = b.groupBy("batch_no").agg(F.max(F.size(symbols)).alias("_longest"))
    x = b.join(longest, "batch_no")
    gap = F.col("_longest") - F.size(symbols)
    return (x.withColumn("padded", F.concat(symbols, F.array_repeat(F.lit(pad), gap)))
            .withColumn("mask", F.concat(F.array_repeat(F.lit(1), (F.size(symbols) / patch).cast("int")),
                                         F.array_repeat(F.lit(0), (gap / patch).cast("int")))).drop("_longest"))


def left_shift_mask(mask: str) -> Column:
    """1 where a patch predicts a data patch after it: the mask, shifted left by one, and itself."""
    m = F.col(mask)
    after = F.concat(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), F.array(F.lit(0)))
    return F.zip_with(m, after, lambda x, y: x * y)


def target_mask(mask: str) -> Column:
    """1 where a data patch is predicted: all but the first."""
    return F.transform(mask, lambda x, i: F.when(i > 0, x).otherwise(0))


def file_patch_arrays(patches: DataFrame, id_col: str) -> DataFrame:
    """(id, patches array<array<int>>): a file's patches in order (one row per file)."""
    ordered = F.array_sort(F.collect_list(F.struct("patch_no", "patch")))
    return patches.groupBy(id_col).agg(F.transform(ordered, lambda s: s["patch"]).alias("patches"))


def concat_pair(input_patches: Column, target_patches: Column, max_patches: int = 1024) -> Column:
    """Input without its end patch, then the target, cut to ``max_patches`` patches."""
    a = input_patches
    return F.slice(F.concat(F.slice(a, 1, F.size(a) - 1), target_patches), 1, max_patches)
