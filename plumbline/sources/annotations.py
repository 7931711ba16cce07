"""Labels and annotations: JSON sidecars, VOC XML, COCO JSON and YOLO text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import stem
from plumbline.operators.validate import orphans, violations

VOC_SCHEMA = "filename string, size struct<width:int,height:int,depth:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,truncated:string,occluded:string,difficult:string>>"
# The twenty classes.
VOC_CLASSES = ("aeroplane", "bicycle", "bird", "boat", "bottle", "bus", "car", "cat", "chair", "cow", "diningtable", "dog", "horse", "motorbike", "person", "pottedplant", "sheep", "sofa", "train", "tvmonitor")
COCO_SCHEMA = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, label) of a sidecar {id: label}, {"labels": {...}} or {id: {"given_label": label}}."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    inner = F.coalesce(F.try_variant_get("v", "$.labels", "variant"), F.col("v"))
    pairs = spark.sql("select e.key as sample_id, e.value as value from {whole}, lateral variant_explode(v) e", whole=whole.select(inner.alias("v")))
    given = F.try_variant_get("value", "$.given_label", "string")
    return pairs.select("sample_id", F.coalesce(given, F.try_variant_get("value", "$", "string")).alias("label"))


def voc(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, file_path, width, height, depth, objects) of annotation files; coordinates become integers."""
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path).withColumn("file_path", F.col("_metadata.file_path"))
    flag = lambda c: F.coalesce(c.isin("1", "true", "True"), F.lit(False))
    objects = F.transform(F.coalesce("object", F.array().cast("array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,truncated:string,occluded:string,difficult:string>>")), lambda o, i: F.struct(i.alias("object_index"), o["name"].alias("class"), *(o["bndbox"][c].cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), flag(o["truncated"]).alias("truncated"), flag(o["occluded"]).alias("occluded"), flag(o["difficult"]).alias("difficult")))
    return raw.select(F.regexp_extract("file_path", r"([^/]+)\.xml$", 1).alias("sample_id"), "file_path", F.col("size.width").alias("width"), F.col("size.height").alias("height"), F.col("size.depth").alias("depth"), objects.alias("objects"))


def voc_violations(classes: tuple[str, ...] = VOC_CLASSES) -> Column:
    """Violations of an annotated sample; a box may pass the border by two pixels."""
    every = lambda f: F.forall("objects", f)
    return violations(
        no_objects=F.size("objects") > 0,
        size=(F.col("width") > 0) & (F.col("height") > 0),
        negative=every(lambda o: (o["xmin"] >= 0) & (o["ymin"] >= 0)),
        degenerate=every(lambda o: (o["xmax"] > o["xmin"]) & (o["ymax"] > o["ymin"])),
        outside=every(lambda o: (o["xmax"] <= F.col("width") + 2) & (o["ymax"] <= F.col("height") + 2)),
        unknown_class=every(lambda o: o["class"].isin(*classes)),
    )


def primary_class(samples: DataFrame) -> DataFrame:
    """`samples` with primary_class, that of the largest box (the first of equals), and all_classes."""
    area = lambda o: (o["xmax"] - o["xmin"]) * (o["ymax"] - o["ymin"])
    best = F.array_min(F.transform("objects", lambda o: F.struct((-area(o)).alias("a"), o["object_index"].alias("i"), o["class"].alias("c"))))
    return samples.withColumn("primary_class", best["c"]).withColumn("all_classes", F.array_sort(F.array_distinct(F.transform("objects", lambda o: o["class"]))))


def voc_statistics(samples: DataFrame) -> DataFrame:
    """(class, objects, images, truncated, occluded, difficult): a row a class; an image counts once."""
    each = samples.select("sample_id", F.explode("objects").alias("o"))
    return each.groupBy(F.col("o.class").alias("class")).agg(F.count("*").alias("objects"), F.count_distinct("sample_id").alias("images"), *(F.count_if(F.col(f"o.{c}")).alias(c) for c in ("truncated", "occluded", "difficult")))


def voc_summary(samples: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """(images, objects, difficult, truncated, occluded, mean_objects, splits) of a whole set; splits is a map of the images of each, `split` (sample_id, split)."""
    n = F.size("objects")
    count = lambda c: F.sum(F.size(F.filter("objects", lambda o: o[c]))).alias(c)
    total = samples.agg(F.count("*").alias("images"), F.coalesce(F.sum(n), F.lit(0)).alias("objects"), *map(count, ("difficult", "truncated", "occluded")))
    named = samples.select("sample_id").join(split, "sample_id", "left") if split is not None else samples.select("sample_id", F.lit(None).cast("string").alias("split"))
    by_split = named.groupBy(F.coalesce("split", F.lit("trainval")).alias("split")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("splits"))
    return total.crossJoin(F.broadcast(by_split)).select("*", F.round(F.col("objects") / F.greatest("images", F.lit(1)), 2).alias("mean_objects"))


def image_ids(spark: SparkSession, lists: str, annotations: str, split: str | None = None) -> DataFrame:
    """(sample_id) of a split, or of all annotation files where its list is missing, empty or not asked for."""
    if split and not (named := split_list(spark, lists, split)).isEmpty():
        return named.select("sample_id")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(annotations)
    return found.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("sample_id"))


def split_list(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """(sample_id, split) of one list; none where there is no such file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}.txt")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "sample_id string, split string")
    return spark.read.text(f"{folder}/{split}.txt").select(F.trim("value").alias("sample_id"), F.lit(split).alias("split")).filter("sample_id <> ''")


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, split) of train.txt, val.txt and trainval.txt, as far as they are there; the first of train, val and trainval that names a sample counts."""
    lines = split_list(spark, folder, "train").unionByName(split_list(spark, folder, "val")).unionByName(split_list(spark, folder, "trainval"))
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return lines.groupBy("sample_id").agg(F.min_by("split", order).alias("split"))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of a COCO file, as three tables."""
    raw = spark.read.schema(COCO_SCHEMA).json(path, multiLine=True)
    part = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    return part("images"), part("annotations"), part("categories")


def coco_violations() -> Column:
    """Violations of an annotation row: four finite numbers, no negative size, no box left of or above the image."""
    b = F.col("bbox")
    finite = (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return violations(bbox_form=finite, bbox_size=(F.get(b, 2) >= 0) & (F.get(b, 3) >= 0), bbox_place=(F.get(b, 0) + F.get(b, 2) >= 0) & (F.get(b, 1) + F.get(b, 3) >= 0))


def coco_integrity(images: DataFrame, annotations: DataFrame, categories: DataFrame, files: DataFrame) -> DataFrame:
    """(relation, n) of annotations without image or category (if there are any categories) and images without a file (path)."""
    named = images.withColumn("stem", stem(F.col("file_name")))
    checks = orphans(annotations, images, ("image_id", "id"), "annotation.image_id").unionByName(orphans(named.select("stem"), files.select(stem(F.col("path")).alias("stem")), ("stem", "stem"), "image.file"))
    return checks if categories.isEmpty() else checks.unionByName(orphans(annotations, categories, ("category_id", "id"), "annotation.category_id"))


def yolo(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, line_no, tokens, class_id, violations): a row a non-blank line of label files."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    tokens = text.select(F.lower("file").alias("sample_id"), "line_no", F.split(F.trim("line"), r"\s+").alias("tokens"))
    number = lambda i: F.get("tokens", i).try_cast("double")
    inside = F.lit(True)
    for i in range(1, 5):
        inside &= F.coalesce((number(i) >= 0) & (number(i) <= 1), F.lit(False))
    broken = violations(tokens=F.size("tokens") >= 5, class_id=F.get("tokens", 0).try_cast("int") >= 0, coordinates=inside)
    return tokens.withColumn("class_id", F.get("tokens", 0).try_cast("int")).withColumn("violations", broken)


def yolo_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of the names list of a YAML file, in flow or block form."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"names:\s*(\[[^\]]*\]|(?:\s*(?:-|\d+:)\s*[^\n]+\n?)+)", 1).alias("n"))
    words = F.regexp_extract_all("n", F.lit(r"(?:-\s+|\d+:\s*|[\[,]\s*)['\"]?([^,'\"\]\n]+)"), 1)
    return whole.select(F.posexplode(words).alias("class_id", "name")).select("class_id", F.trim("name").alias("name"))


def first_labels(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(sample_id, class_id) of the first line of each label file; files whose first line has no class id are left out.

    With `names` (class_id, name) a label column too: the name, or the number where it has none.
    """
    first = lines.groupBy("sample_id").agg(F.min_by("class_id", "line_no").alias("class_id")).filter("class_id >= 0")
    if names is None:
        return first
    return first.join(F.broadcast(names), "class_id", "left").select("sample_id", "class_id", F.coalesce(F.nullif("name", F.lit("")), F.col("class_id").cast("string")).alias("label"))


def coco_first_labels(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(sample_id, label) of the first annotation of each image, in the order of the file: its category's name, or number where it has none."""
    order = annotations.withColumn("__no", F.monotonically_increasing_id())
    named = images.select(F.col("id").alias("image_id"), stem(F.col("file_name")).alias("sample_id")).filter("sample_id <> ''")
    first = order.join(named, "image_id").groupBy("sample_id").agg(F.min_by("category_id", "__no").alias("category_id"))
    known = categories.groupBy(F.col("id").alias("category_id")).agg(F.max_by("name", "id").alias("name"))
    return first.join(F.broadcast(known), "category_id", "left").select("sample_id", F.coalesce(F.nullif("name", F.lit("")), F.col("category_id").cast("string")).alias("label"))
