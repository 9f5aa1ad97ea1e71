"""Manifests, splits, batches, augmentation choices and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from normatile.functions import paths
from normatile.functions.scores import label_name
from normatile.operators import catalogue as cat
from normatile.operators import ordering
from normatile.operators.scoring import image_score
from normatile.plans import fixtures as fx
from normatile.plans.fixtures import r6
from normatile.plans.registry import query
from normatile.plans.scoring_queries import scored64
from normatile.session import materialize, new_folder
from normatile.sources import image_scan, reports


def manifest(spark, sf):
    return cat.manifest(fx.files(spark, sf))


@query(
    "manifest_paths",
    "SELECT path, category, split, defect_type, file_name, image_name, label FROM manifest",
    ("manifest",),
)
def manifest_paths(spark, sf):
    return manifest(spark, sf)


@query(
    "mask_join",
    """SELECT path, label, CASE WHEN split = 'test' AND label = 1 AND doc_id % 2 = 0 THEN
    '/root/' || category || '/ground_truth/' || defect_type || '/' || image_name || '_mask.png' END AS mask_path
    FROM manifest""",
    ("manifest",),
)
def mask_join(spark, sf):
    files = fx.files(spark, sf)
    return cat.attach_masks(cat.manifest(files), cat.mask_files(files)).select("path", "label", "mask_path")


_ORDINAL = """SELECT *, row_number() OVER (PARTITION BY category, split ORDER BY defect_type, file_name) - 1 AS ordinal
FROM manifest"""


@query("image_ordinals", f"SELECT path, category, split, ordinal FROM ({_ORDINAL})", ("manifest",))
def image_ordinals(spark, sf):
    return cat.with_ordinal(manifest(spark, sf)).select("path", "category", "split", "ordinal")


@query(
    "dataset_audit",
    """WITH small AS (SELECT category || '-' || (doc_id % 37) AS category, split, defect_type FROM manifest),
    counts AS (SELECT category, split, defect_type, count(*) AS n FROM small GROUP BY ALL),
    wanted AS (SELECT category, split, 'good' AS defect_type FROM (SELECT DISTINCT category FROM counts),
    (VALUES ('train'), ('test')) s(split))
    SELECT category, split, defect_type, coalesce(n, 0) AS n_images, n IS NULL AS missing
    FROM counts FULL JOIN wanted USING (category, split, defect_type)""",
    ("manifest",),
)
def dataset_audit(spark, sf):
    """Categories of a few images each: many lack a required folder."""
    part = (F.col("image_name").cast("long") % 37).cast("string")
    return cat.dataset_audit(manifest(spark, sf).withColumn("category", F.concat_ws("-", "category", part)))


@query(
    "ordinal_subset",
    f"SELECT path, ordinal FROM ({_ORDINAL}) o WHERE (category, ordinal) IN (SELECT source, n_chars % 7 FROM documents)",
    ("manifest",),
)
def ordinal_subset(spark, sf):
    listed = fx.table(spark, sf, "documents").select(
        F.col("source").alias("category"), (F.col("n_chars") % 7).alias("ordinal")
    )
    return cat.subset(cat.with_ordinal(manifest(spark, sf)), listed).select("path", "ordinal")


@query(
    "first_anomalous",
    "SELECT path, image_name FROM manifest WHERE label = 1 ORDER BY category, split, path LIMIT 10",
    ("manifest",),
)
def first_anomalous(spark, sf):
    found = cat.first_anomalous(manifest(spark, sf), 10, ["category", "split", "path"])
    return found.select("path", "image_name")


@query(
    "path_names",
    """SELECT path, defect_type || '_' || image_name || '_heatmap.png' AS artifact,
    'sample_' || lpad(CAST(label AS VARCHAR), 3, '0') || '_' || image_name || '.png' AS sample,
    CASE WHEN label = 1 THEN 'Anomaly' ELSE 'Normal' END AS verdict FROM manifest""",
    ("manifest",),
)
def path_names(spark, sf):
    p = F.col("path")
    return manifest(spark, sf).select(
        "path",
        paths.artifact_name(paths.parent_dir(p), paths.stem(p), "heatmap").alias("artifact"),
        paths.sample_name(F.col("label"), F.col("image_name")).alias("sample"),
        label_name(F.col("label")).alias("verdict"),
    )


@query(
    "page_paths",
    r"""SELECT page_id, list_extract(string_split(url, '/'), -1) AS base,
    list_extract(string_split(url, '/'), -2) AS parent FROM pages""",
)
def page_paths(spark, sf):
    url = F.col("url")
    return fx.table(spark, sf, "pages").select(
        "page_id", paths.base_name(url).alias("base"), paths.parent_dir(url).alias("parent")
    )


_SPLIT = """SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= {quota}
THEN 'val' ELSE 'train' END AS part FROM documents"""


@query("key_split_half", _SPLIT.format(quota="count(*) OVER (PARTITION BY lang) // 2"))
def key_split_half(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return ordering.permutation_split(docs, "doc_id", group=["lang"], by_hash=False)


@query("key_split_fixed", _SPLIT.format(quota="greatest(1, least(40, count(*) OVER (PARTITION BY lang) - 1))"))
def key_split_fixed(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return ordering.permutation_split(docs, "doc_id", n_val=40, group=["lang"], by_hash=False)


@query(
    "seeded_split",
    f"""SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {fx.md5_number("42", "doc_id")}, doc_id) - 1
    < count(*) OVER (PARTITION BY lang) // 2 THEN 'val' ELSE 'train' END AS part FROM documents""",
)
def seeded_split(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return ordering.permutation_split(docs, "doc_id", seed=42, group=["lang"])


@query(
    "seeded_split_counts",
    """SELECT lang, CAST(count(*) // 2 AS BIGINT) AS n_val, CAST(count(*) - count(*) // 2 AS BIGINT) AS n_train,
    CAST(0 AS BIGINT) AS n_both FROM documents GROUP BY lang""",
)
def seeded_split_counts(spark, sf):
    """The hashed split has exact sizes, and its parts are disjoint."""
    parts = seeded_split(spark, sf)
    per_doc = parts.groupBy("lang", "doc_id").agg(F.count_distinct("part").alias("parts"), F.min("part").alias("part"))
    return per_doc.groupBy("lang").agg(
        F.count_if(F.col("part") == "val").alias("n_val"),
        F.count_if(F.col("part") == "train").alias("n_train"),
        F.count_if(F.col("parts") > 1).alias("n_both"),
    )


@query(
    "assign_batches",
    """SELECT doc_id, position, position // 8 AS batch_id FROM (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)""",
)
def assign_batches(spark, sf):
    """Evaluation batches: key order, the partial batch is kept."""
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return ordering.assign_batches(docs, "doc_id", 8, shuffle=False, drop_last=False)


@query(
    "shuffled_batches",
    f"""SELECT doc_id, position, position // 48 AS batch_id FROM (SELECT doc_id, count(*) OVER () AS n,
    row_number() OVER (ORDER BY {fx.md5_number("7", "3", "doc_id")}, doc_id) - 1 AS position FROM documents)
    WHERE position // 48 < n // 48""",
)
def shuffled_batches(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return ordering.assign_batches(docs, "doc_id", 48, seed=7, epoch=3)


@query(
    "shuffled_batch_sizes",
    """SELECT batch_id, CAST(48 AS BIGINT) AS n FROM (SELECT count(*) // 48 AS batches FROM documents),
    LATERAL (SELECT unnest(range(0, batches)) AS batch_id)""",
)
def shuffled_batch_sizes(spark, sf):
    """Training batches are all full."""
    return shuffled_batches(spark, sf).groupBy("batch_id").agg(F.count("*").alias("n"))


@query(
    "sample_rows",
    f"SELECT doc_id, n_chars FROM documents ORDER BY {fx.md5_number('42', 'doc_id')}, doc_id LIMIT 100",
)
def sample_rows(spark, sf):
    return ordering.sample_rows(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 100)


@query(
    "shuffle_rows",
    f"""SELECT doc_id, lang, row_number() OVER (ORDER BY {fx.md5_number("42", "2", "doc_id")}, doc_id) - 1 AS position
    FROM documents""",
)
def shuffle_rows(spark, sf):
    """The order itself: the numbers of the sorted rows, partition by partition."""
    rows = ordering.shuffled(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", epoch=2)
    placed = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "shuffled")
    return ordering.with_position(placed, ["_id"]).drop("_id")


@query(
    "null_group_batches",
    """SELECT doc_id, lang, position, position // 8 AS batch_id FROM (SELECT doc_id, nullif(lang, 'en') AS lang,
    row_number() OVER (PARTITION BY nullif(lang, 'en') ORDER BY doc_id) - 1 AS position FROM documents)""",
)
def null_group_batches(spark, sf):
    """Rows without a group are a group of their own."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"))
    return ordering.assign_batches(docs, "doc_id", 8, shuffle=False, drop_last=False, group=["lang"])


@query(
    "head_rows",
    "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25",
)
def head_rows(spark, sf):
    return ordering.head(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 25)


@query(
    "method_lookup",
    """SELECT p_partkey, unnest(CASE WHEN name IN ('carpet', 'leather', 'zipper') OR name NOT IN ('screw', 'tile', 'wood')
    THEN ['cutpaste'] ELSE ['cutpaste', 'crack'] END) AS method FROM (SELECT p_partkey, CASE p_type
    WHEN 'PROMO' THEN 'screw' WHEN 'SMALL' THEN 'carpet' WHEN 'LARGE' THEN 'tile' WHEN 'MEDIUM' THEN 'zipper'
    ELSE lower(p_type) END AS name FROM part)""",
)
def method_lookup(spark, sf):
    """Part types stand in for categories, upper case and unknown ones among them."""
    names = F.create_map(*[F.lit(v) for v in ("PROMO", "SCREW", "SMALL", "Carpet", "LARGE", "TILE", "MEDIUM", "zipper")])
    category = F.coalesce(F.try_element_at(names, F.col("p_type")), F.col("p_type"))
    return fx.table(spark, sf, "part").select("p_partkey", F.explode(cat.methods_for(category)).alias("method"))


@query(
    "method_errors",
    "SELECT p_partkey FROM part WHERE p_type NOT IN ('PROMO', 'LARGE')",
)
def method_errors(spark, sf):
    """Categories that do not allow cracks."""
    names = F.create_map(*[F.lit(v) for v in ("PROMO", "screw", "SMALL", "carpet", "LARGE", "tile", "MEDIUM", "zipper")])
    parts = fx.table(spark, sf, "part").withColumn("category", F.coalesce(F.try_element_at(names, F.col("p_type")), F.col("p_type")))
    return cat.method_errors(parts, "category", "crack").select("p_partkey")


@query(
    "seeded_augment_plan",
    f"""SELECT p_partkey, category, augment, CASE WHEN augment THEN CASE WHEN category IN ('carpet', 'leather', 'zipper')
    OR category NOT IN ('screw', 'tile', 'wood') THEN 'cutpaste'
    ELSE ['cutpaste', 'crack'][{fx.md5_number("42", "'method'", "p_partkey")} % 2 + 1] END END AS method
    FROM (SELECT p_partkey, lower(p_type) AS category,
    {fx.md5_number("42", "'apply'", "p_partkey")} / 4503599627370496.0::DOUBLE < 0.2 AS augment FROM part)""",
)
def seeded_augment_plan(spark, sf):
    parts = fx.table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("category"))
    return cat.augmentation_plan(parts, "p_partkey", "category", p=0.2, seed=42)


@query(
    "rank_images",
    """SELECT image_id, label, round(image_score, 6) AS score,
    row_number() OVER (ORDER BY image_score DESC, image_id) - 1 AS rank FROM image_scores""",
    ("image_scores",),
)
def rank_images(spark, sf):
    images = image_score(scored64(spark, sf)).join(fx.images(spark, sf).select("image_id", "label"), "image_id")
    ranked = ordering.with_position(images, [F.desc("image_score"), "image_id"], name="rank")
    return ranked.select("image_id", "label", r6(F.col("image_score")).alias("score"), "rank")


def scored_images(spark, sf):
    images = image_score(scored64(spark, sf)).join(fx.images(spark, sf), "image_id")
    defect = F.when(F.col("label") == 0, "good").otherwise("defect")
    name = F.format_string("%04d", "image_id")
    return images.withColumns(
        {
            "defect_type": defect,
            "image_name": name,
            "path": F.concat_ws("/", F.lit("/root"), "category", F.lit("test"), defect, F.concat(name, F.lit(".png"))),
            "score": F.col("image_score"),
        }
    )


@query(
    "score_report",
    """SELECT category, CASE WHEN label = 0 THEN 'good' ELSE 'defect' END AS defect_type,
    lpad(CAST(image_id AS VARCHAR), 4, '0') AS image_name, '/root/' || category || '/test/' ||
    CASE WHEN label = 0 THEN 'good' ELSE 'defect' END || '/' || lpad(CAST(image_id AS VARCHAR), 4, '0') || '.png'
    AS image_path, printf('%.6f', image_score) AS anomaly_score, label,
    CASE WHEN label = 1 THEN 'Anomaly' ELSE 'Normal' END AS is_anomaly FROM image_scores""",
    ("image_scores",),
)
def score_report(spark, sf):
    """Written as CSV folders and read back."""
    folder = new_folder(spark, "report")
    reports.write_score_report(scored_images(spark, sf), folder)
    schema = (
        "defect_type string, image_name string, image_path string, anomaly_score string, label int, "
        "is_anomaly string, category string"
    )
    return spark.read.schema(schema).option("header", True).csv(folder)


@query(
    "prompt_text",
    """SELECT conv_id, turn, 'Describe the object.' || chr(10) || '<' || role || '>' || text || '</' || role || '>'
    AS prompt FROM conversations""",
)
def prompt_text(spark, sf):
    prefix = F.concat(F.lit("<"), "role", F.lit(">"))
    suffix = F.concat("text", F.lit("</"), "role", F.lit(">"))
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", paths.compose_prompt(F.lit("Describe the object."), prefix, suffix).alias("prompt")
    )


def _damaged(files):
    """Cut every image file whose number leaves 3 by 7 in half, and empty those that leave 5."""

    def damage(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                number = int(path.rsplit("/", 1)[1].removesuffix(".png")) % 7
                system, name = image_scan.opened(path)
                if number in (3, 5):
                    with system.open_input_stream(name) as stream:
                        whole = stream.read()
                    with system.open_output_stream(name) as out:
                        out.write(whole[: len(whole) // 2] if number == 3 else b"")
            yield batch

    return materialize(files.mapInArrow(damage, files.schema), "damaged")


@query(
    "image_scan",
    """SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(c AS INT) AS c, CAST(v AS INT) AS v, false AS bad FROM pixels
    WHERE image_id % 7 NOT IN (3, 5) AND image_id % 4 <> 1
    UNION ALL SELECT image_id, NULL, NULL, NULL, NULL, true FROM images WHERE image_id % 7 IN (3, 5) AND image_id % 4 <> 1""",
    ("images", "pixels"),
)
def scanned_images(spark, sf):
    """Images written as files, some of them damaged, and three quarters of them read again through the image source."""
    files = _damaged(image_scan.write_images(fx.pixels(spark, sf), new_folder(spark, "images")))
    number = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long")
    out = image_scan.scan_images(files.where(number % 4 != 1), partition_bytes=32 << 10)
    return out.select(number.alias("image_id"), "y", "x", "c", "v", F.col("error").isNotNull().alias("bad"))
