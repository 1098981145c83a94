"""Scans of annotation, result and content files. Schemas are stated, never
inferred, so a scan is one pass and columns are pruned."""

from __future__ import annotations

from functools import cache, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "array<int>"
LABELS = f"""image_id string, image_path string, full_text string, lines array<string>,
line_boxes array<struct<line:string,box:{BOX}>>, word_boxes array<array<struct<word:string,box:{BOX},left:int,top:int,right:int,bottom:int>>>,
char_boxes array<array<struct<char:string,box:{BOX}>>>, text_category string, has_ambiguous_chars boolean, num_lines int, num_chars int,
font_family string, font_size_pt int, font_size_label string, font_bold boolean, text_color array<int>, bg_color array<int>, background_type string,
contrast_level string, layout_type string, img_width int, img_height int, split string, domain string, category string, render_mode string"""
RESULTS = """image_id string, model_name string, is_held_out boolean, epsilon double, kappa double, objective_config string, proxy_stage string,
cer_clean double, cer_adv double, cer_delta double, wer_clean double, wer_adv double, wer_delta double, exact_clean boolean, exact_adv boolean,
constraint_satisfied boolean, fm_ens_final double, lh_final double, transfer_ratio double, text_category string, contrast_level string,
_event string, _timestamp double"""
# What an absent field counts as.
DEFAULTS = {"num_lines": 1, "num_chars": 0, "font_family": "unknown", "text_category": "unknown", "img_width": 768, "img_height": 192}
# Parts of file names that tell a font's family.
MONO, SERIF = "mono|courier|consol|inconsolata|hack|jetbrains", "serif|georgia|times|garamond|merriweather|playfair"


def labels(spark: SparkSession, folder: str, suffix: str = "", more: str | None = None, cap: int | None = None, **equal) -> DataFrame:
    """SRC1, PRJ2: ``labels.jsonl`` (or ``labels_{suffix}.jsonl``), and those of a
    further folder after them, with defaults and ``ord``, the line's place: which
    folder, file, block of the file, and row within the block. Malformed lines and
    a missing file raise, blank lines are skipped; both forms of word boxes give
    ``box``. ``equal`` are filters by column (FIL1: an empty one is off, a list
    means any of its values, null never equals), ``cap`` keeps the first rows by
    ``ord`` after them (TOP1); then only as many of the first files are read as
    hold that many rows."""
    name = f"labels_{suffix}.jsonl" if suffix else "labels.jsonl"
    places = [f"{place}/{name}" for place in ([folder, more] if more else [folder])]
    if not cap:
        return _labels(spark, [[p] for p in places], equal)
    files = [(k, f) for k, p in enumerate(places) for f in sorted(spark.read.text(p).inputFiles())]
    take = 1
    while True:
        rows = _labels(spark, [[f for k, f in files[:take] if k == n] for n in range(len(places))], equal)
        if take >= len(files) or rows.limit(cap).count() == cap:
            return rows.orderBy("ord").limit(cap)
        take *= 4


def _labels(spark: SparkSession, folders: list[list[str]], equal: dict) -> DataFrame:
    parts = []
    for k, paths in enumerate(folders):
        if not paths:
            continue
        rows = spark.read.schema(LABELS).option("mode", "FAILFAST").json(paths)
        order = F.struct(F.lit(k).alias("folder"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        parts.append(rows.withColumn("ord", order))
    rows = reduce(DataFrame.unionByName, parts)
    box = lambda w: F.struct(w["word"].alias("word"), F.coalesce(w["box"], F.array(w["left"], w["top"], w["right"], w["bottom"])).alias("box"))
    rows = rows.withColumn("word_boxes", F.transform("word_boxes", lambda ws: F.transform(ws, box)))
    rows = rows.withColumn("lines", F.coalesce("lines", F.array("full_text")))
    rows = rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()})
    for column, value in equal.items():
        if value:
            rows = rows.filter(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    return rows


def flat_words(rows: DataFrame) -> DataFrame:
    """ARR1: one row per word and box."""
    w = rows.select("image_id", F.posexplode(F.flatten("word_boxes")).alias("pos", "w"))
    return w.select("image_id", "pos", "w.word", *[F.col("w.box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def results(spark: SparkSession, path: str, held_out: bool = False) -> DataFrame:
    """SRC3: result rows of a log that events share; held-out ones on request."""
    rows = spark.read.schema(RESULTS).json(path).filter("image_id IS NOT NULL AND model_name IS NOT NULL")
    return rows if held_out else rows.filter(~F.coalesce("is_held_out", F.lit(False)))


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event rows of the same log."""
    return spark.read.schema(RESULTS).json(path).filter("_event IS NOT NULL")


def content_bank(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC4, SRC5: a list of items, or the older ``{"items": [{data, category,
    content_id}]}``; ``schema`` is that of an item. Anything else raises."""
    begin = F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)
    kinds = {r[0] for r in spark.read.option("wholetext", True).text(path).select(begin).distinct().collect()}
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if kinds <= {"["}:
        return reader.schema(f"{schema}, _category string, _content_id string").json(path)
    legacy = f"items array<struct<data:struct<{_colon(schema)}>,category:string,content_id:string>>"
    old = reader.schema(legacy).json(path)
    if kinds != {"{"} or old.filter("items IS NULL").limit(1).count():
        raise ValueError(f"{path} is neither a list of items nor has one")
    one = old.select(F.explode("items").alias("i"))
    return one.select("i.data.*", F.col("i.category").alias("_category"), F.col("i.content_id").alias("_content_id"))


def _colon(schema: str) -> str:
    return ", ".join(":".join(part.strip().split(None, 1)) for part in schema.split(","))


def resumed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC6: what an earlier run has saved; nothing where there is no file or it
    can't be read."""
    try:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        rows.count()
        return rows
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            print(f"starting anew, {path} can't be read")
        return spark.createDataFrame([], schema)


def fonts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC8: font files by family, told by their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[ot]tf").option("recursiveFileLookup", True).load(folder)
    stem = F.lower(F.regexp_extract("path", r"([^/]+)\.[ot]tf$", 1))
    return files.select("path", F.when(stem.rlike(MONO), "mono").when(stem.rlike(SERIF), "serif").otherwise("sans").alias("family"))


@cache
def listed(folder: str) -> frozenset[str]:
    """The paths of a local folder, looked up once."""
    return frozenset(map(str, Path(folder).rglob("*")))


@cache
def first_existing(names: tuple[str, ...], folder: str, default: str | None = None) -> str | None:
    """SRC9: the first of the candidates that exists below the folder, kept for
    the next time it is asked for."""
    return next((n for n in names if str(Path(folder) / n) in listed(folder)), default)


def config(path: str, kinds: dict | None = None) -> dict:
    """SRC7: a YAML file, with named fields cast (on the driver)."""
    import yaml

    with open(path) as f:
        found = yaml.safe_load(f) or {}
    return {k: kinds[k](v) if kinds and k in kinds else v for k, v in found.items()}
