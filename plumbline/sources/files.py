"""Gates for uploaded files and bundles, and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.rules import chain

# Extensions that are never accepted as annotations, and the first bytes of known binary kinds.
BLOCKED = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "mp4", "avi", "zip", "rar", "tar", "py", "pt", "pth", "onnx", "h5", "pkl", "exe")
MAGIC = (("zip", "504B0304"), ("zip", "504B0506"), ("zip", "504B0708"), ("elf", "7F454C46"), ("pe", "4D5A"), ("pickle", "8002"), ("hdf5", "894844460D0A1A0A"), ("7z", "377ABCAF271C"), ("rar", "52617221"), ("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def magic(content: Column) -> Column:
    """The binary kind of which a file of eight bytes or more has the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.octet_length(content) >= 8, chain(*((head.startswith(prefix), kind) for kind, prefix in MAGIC), otherwise=F.lit(None).cast("string")))


def looks_binary(content: Column) -> Column:
    """A NUL, or over 5 % control characters, in the first 8 KB."""
    text = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F]", ""))
    return text.contains("\0") | (control > 0.05 * F.length(text))


def gate(files: DataFrame, kind: str) -> DataFrame:
    """(path, status, image_count, annotation_count, category_count, errors, warnings, size, sha256) of annotation files (path, content).

    Files with a blocked extension, of a known binary kind or that look binary are rejected. Others are read as
    `kind` (coco or yolo): errors make them invalid, warnings alone a warning.
    """
    content, text = F.col("content"), F.make_valid_utf8(F.col("content").cast("string"))
    ext, known = extension(F.col("path")), magic(F.col("content"))
    refused = chain(
        (ext.isin(*BLOCKED), F.format_string("Blocked file extension '.%s'", ext)),
        (known.isNotNull(), F.format_string("Content is binary (%s); renamed files cannot bypass validation", known)),
        (looks_binary(content), "Content is not decodable text; renamed files cannot bypass validation"),
        otherwise=F.lit(None).cast("string"),
    )
    if kind == "coco":
        parsed = F.from_json(text, "images array<string>, annotations array<string>, categories array<string>", {"mode": "PERMISSIVE"})
        part = lambda name: F.coalesce(F.size(parsed[name]), F.lit(-1))
        broken = F.try_parse_json(text).isNull()
        images, annotations, categories = (F.when(broken, -1).otherwise(part(name)) for name in ("images", "annotations", "categories"))
        errors = F.array(F.when(broken, "Invalid JSON syntax").when(images < 0, "Missing required 'images' array in COCO JSON"))
        warnings = F.array(F.when(~broken & (annotations < 0), "Missing or empty 'annotations' array in COCO JSON"), F.when(~broken & (categories < 0), "Missing or empty 'categories' array in COCO JSON"), F.when(images == 0, "Dataset contains 0 images"))
    elif kind == "yolo":
        lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
        counts = F.transform(F.slice(lines, 1, 100), lambda x, i: F.struct((i + 1).alias("line"), F.size(F.split(F.trim(x), r"\s+")).alias("n")))
        errors = F.transform(F.slice(F.filter(counts, lambda x: x["n"] < 5), 1, 5), lambda x: F.format_string("Line %d: expected at least 5 values (class x y w h), found %d", x["line"], x["n"]))
        images, annotations, categories, warnings = F.lit(1), F.size(lines), F.lit(1), F.array().cast("array<string>")
    else:
        raise ValueError(f"unknown kind {kind}")
    none = F.array().cast("array<string>")
    judged = files.select("path", "content", refused.alias("__refused"), errors.alias("__errors"), warnings.alias("__warnings"), *(F.greatest(c, F.lit(0)).alias(n) for c, n in ((images, "image_count"), (annotations, "annotation_count"), (categories, "category_count"))))
    bad = F.col("__refused").isNotNull()
    named = judged.select(
        "path",
        *(F.when(bad, 0).otherwise(F.col(c)).alias(c) for c in ("image_count", "annotation_count", "category_count")),
        F.when(bad, F.array("__refused")).otherwise(F.array_compact("__errors")).alias("errors"),
        F.when(bad, none).otherwise(F.array_compact("__warnings")).alias("warnings"),
        F.octet_length("content").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        bad.alias("__bad"),
    )
    status = chain((F.col("__bad"), "rejected"), (F.size("errors") > 0, "invalid"), (F.size("warnings") > 0, "warning"), otherwise="valid")
    return named.select("path", status.alias("status"), "image_count", "annotation_count", "category_count", "errors", "warnings", "size", "sha256")


def bundle_kind(files: DataFrame, bundle: str, requested: str | None = None) -> DataFrame:
    """(bundle, kind): coco by its .json files, yolo by its .txt (but classes.txt) or YAML files; where both or neither fit, the requested one, else coco or unknown."""
    path = F.lower("path")
    coco = F.bool_or(path.endswith(".json"))
    yolo = F.bool_or(path.rlike(r"\.txt$") & ~path.rlike(r"classes?\.txt$") | path.rlike(r"\.ya?ml$"))
    wanted = requested.lower() if requested and requested.lower() in ("coco", "yolo") else None
    return files.groupBy(bundle).agg(F.when(coco & yolo, F.lit(wanted or "coco")).when(coco, "coco").when(yolo, "yolo").otherwise(F.lit(wanted or "unknown")).alias("kind"))


def bundle_status(files: DataFrame, bundle: str) -> DataFrame:
    """(bundle, files, errors, warnings, status, bundle_hash) from (bundle, path, length, sha256, status).

    Repeated paths and gate failures are errors, empty files warnings; the hash joins a bundle's own files.
    """
    entries = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.col("length").cast("string"), "sha256"))), "|")
    summed = files.groupBy(bundle).agg(F.count("*").alias("files"), (F.count("*") - F.count_distinct("path") + F.count_if(F.col("status").isin("rejected", "invalid"))).alias("errors"), F.count_if((F.col("status") == "warning") | (F.col("length") == 0)).alias("warnings"), F.sha2(entries, 256).alias("bundle_hash"))
    return summed.withColumn("status", chain((F.col("errors") > 0, "invalid"), (F.col("warnings") > 0, "warning"), otherwise="valid"))


def model_assets(registry: DataFrame, files: DataFrame, allowed: tuple[str, ...] = ("pt", "pth", "onnx", "h5", "safetensors")) -> DataFrame:
    """`registry` (path, registered_sha256, contributor_id, claimed_contributor) with status and reason, against (path, length, sha256)."""
    both = registry.join(files.select("path", "length", "sha256"), "path", "left")
    reason = chain((F.col("sha256").isNull(), "missing"), (F.col("length") == 0, "empty"), (~extension(F.col("path")).isin(*allowed), "extension"), (F.col("registered_sha256") != F.col("sha256"), "digest differs"), (~F.col("contributor_id").eqNullSafe(F.col("claimed_contributor")), "contributor differs"), (F.col("registered_sha256").isNull(), "no registered digest"), otherwise=F.lit(None).cast("string"))
    return both.withColumn("reason", reason).withColumn("status", chain((F.col("reason").isNull(), "VALID"), (F.col("reason").isin("no registered digest", "contributor differs"), "WARNING"), otherwise="INVALID"))


def availability(registry: DataFrame, files: DataFrame) -> DataFrame:
    """`registry` (asset_id, path) with available and reason: the path, or the folder, must hold bytes.

    A file is known by its own path and by those of all folders above it, so that one equi-join answers.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = files.select(F.explode(above).alias("path"), "length").groupBy("path").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    joined = registry.join(held, "path", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})
    return joined.select("asset_id", "path", (F.col("bytes") > 0).alias("available"), chain((F.col("n") == 0, "not found"), (F.col("bytes") == 0, "empty"), otherwise="present").alias("reason"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(file, asset_id, reason, severity, confidence) of stored results, in whichever of the known shapes: results[].finding, results[].image_id, sample_findings[] or a bare list."""
    item = "struct<finding:struct<assetID:string,reason:string,severity:string,confidence:string>,image_id:string,sample_id:string,assetID:string,reason:string,severity:string,confidence:string>"
    flat = "finding struct<assetID:string,reason:string,severity:string,confidence:string>, image_id string, sample_id string, assetID string, reason string, severity string, confidence string"
    raw = spark.read.schema(f"results array<{item}>, sample_findings array<{item}>, {flat}").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    bare = F.when(F.coalesce("finding.assetID", "image_id", "sample_id", "assetID").isNotNull(), F.array(F.struct("finding", "image_id", "sample_id", "assetID", "reason", "severity", "confidence")))
    rows = raw.select("file", F.explode(F.concat(*(F.coalesce(c, F.array().cast(f"array<{item}>")) for c in (F.col("results"), F.col("sample_findings"), bare)))).alias("r"))
    pick = lambda c: F.coalesce(F.col(f"r.finding.{c}"), F.col(f"r.{c}"))
    return rows.select("file", F.coalesce("r.finding.assetID", "r.assetID", "r.image_id", "r.sample_id").alias("asset_id"), pick("reason").alias("reason"), pick("severity").alias("severity"), pick("confidence").try_cast("double").alias("confidence"))


def evidence_listing(spark: SparkSession, *paths: str) -> DataFrame:
    """(evidence_id, file, module_name, schema, ts, related, size, evidence) of JSON texts in several stores, the newest first; malformed ones are left out."""
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.col("value"), F.try_parse_json("value").alias("evidence"))
    field = lambda *names: F.coalesce(*(F.get_json_object("value", f"$.{name}") for name in names))
    name = F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1)
    listed = text.filter("evidence is not null").select(
        name.alias("evidence_id"),
        "file",
        field("moduleName", "module").alias("module_name"),
        field("schema").alias("schema"),
        F.coalesce(field("timestamp", "generatedAt"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"),
        F.coalesce(field("assetID", "sample_id"), F.concat(F.lit("asset-"), F.substring(name, 1, 8))).alias("related"),
        "size",
        "evidence",
    )
    return listed.orderBy(F.desc("ts"), "evidence_id")


def evidence_by_hash(findings: DataFrame, listing: DataFrame, hash_: str = "evidence_hash") -> DataFrame:
    """`findings` with the evidence of the file whose name is their hash, null if there is none."""
    return findings.join(listing.select(F.col("evidence_id").alias(hash_), "evidence").dropDuplicates([hash_]), hash_, "left")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """(assessment_id, file, schema_version, overall_status, disposition, findings, ts) of stored reports, the newest first; other JSON files are left out."""
    text = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    listed = text.select(field("assessment_id").alias("assessment_id"), "file", field("schema_version").alias("schema_version"), field("overall_assessment.overall_status").alias("overall_status"), field("overall_assessment.disposition").alias("disposition"), F.coalesce(F.json_array_length(field("findings")), F.lit(0)).alias("findings"), field("assessment_timestamp").alias("ts"))
    return listed.filter("assessment_id is not null").orderBy(F.desc("ts"), "assessment_id")


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, label, original_label, corruption) of a JSON object by sample id, or of its field labels, with null for the fields that an entry lacks."""
    whole = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.labels"), "value").alias("value"))
    entries = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("sample_id", "entry"))
    field = lambda *names: F.coalesce(*(F.get_json_object("entry", f"$.{name}") for name in names))
    return entries.select("sample_id", field("label", "assigned_label").alias("label"), field("original_label", "true_label").alias("original_label"), field("corruption", "type").alias("corruption"))


def examples(spark: SparkSession, path: str) -> DataFrame:
    """(file, true_label) of a model's example CSV; rows without a whole number as label are left out."""
    rows = spark.read.schema("file string, true_label string").option("header", "true").csv(path)
    return rows.select(F.trim("file").alias("file"), F.col("true_label").try_cast("int").alias("true_label")).filter("file <> '' and true_label is not null")


def store_evidence(target: str, evidence: DataFrame) -> int:
    """Append the evidence (evidence_hash, payload) that a content-addressed table lacks; returns how many rows that were."""
    spark = evidence.sparkSession
    rows = evidence.dropDuplicates(["evidence_hash"])
    try:
        rows = rows.join(spark.read.parquet(target).select("evidence_hash"), "evidence_hash", "left_anti")
    except Exception as error:  # noqa: BLE001  the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    n = rows.count()
    rows.write.mode("append").parquet(target)
    return n


def write_results(target: str, rows: DataFrame, **summary: DataFrame) -> None:
    """A run's rows as JSON lines under `target`/findings, and each summary table under its name; each replaces the run's earlier one."""
    rows.write.mode("overwrite").json(f"{target}/findings")
    for name, frame in summary.items():
        frame.write.mode("overwrite").json(f"{target}/{name}")


def append_journal(target: str, entries: DataFrame) -> int:
    """Append the submissions (tx_id, ...) that a journal lacks; returns how many rows those were."""
    spark = entries.sparkSession
    rows = entries.dropDuplicates(["tx_id"])
    try:
        rows = rows.join(spark.read.schema(entries.schema).parquet(target).select("tx_id"), "tx_id", "left_anti")
    except Exception as error:  # noqa: BLE001  the journal does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    n = rows.count()
    rows.write.mode("append").parquet(target)
    return n
