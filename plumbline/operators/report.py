"""Assurance reports as documents: assembled from tables, and verified back to tables.

A report is a root document and its parts. Findings, checks, coverage and audit events are written in canonical
JSON in pages of at most PAGE rows, each a part with the SHA-256 of its text; the root lists the parts with
their digests beside the overall assessment and its own hash. So nothing that grows with an assessment is
gathered in one row but one digest for every PAGE rows.

The verifier starts from the texts alone. It takes the root's hash, every part's digest, the findings'
form, the overall assessment, the hashes that bind evidence and the chain of events again and names what differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.text import canonical, canonical_value
from plumbline.operators import chain, governance
from plumbline.operators.drift import in_parts, numbered
from plumbline.operators.evidence import CATEGORIES, DISPOSITIONS, SEVERITIES, STATUSES
from plumbline.operators.profile import in_groups
from plumbline.tables import durable

#: Rows of a page, and pages of a file.
PAGE, FILE_PAGES = 1_000, 32
SCHEMA_VERSION = "1.1"
# The fields of the rows of each part.
FINDING = "finding_id string, category string, asset_id string, status string, severity string, confidence double, title string, reason string, ts string, module_name string, evidence_hash string, disposition string, priority string"
CHECK = "check_id string, category string, name string, module string, status string"
COVERAGE = "kind string, name string, support_status string, n bigint"
EVENT = "assessment_id string, sequence_index bigint, timestamp string, event_type string, actor string, reference_ids array<string>, data map<string,string>"
PARTS = {"findings": (FINDING, "finding_id"), "checks": (CHECK, "check_id"), "coverage": (COVERAGE, "name"), "events": (f"{EVENT}, previous_event_hash string, event_hash string", "sequence_index")}
ROOT = "assessment_id string, assessment_timestamp string, schema_version string, overall_assessment struct<overall_status:string,disposition:string>, parts array<struct<part:string,page:int,rows:bigint,digest:string>>"


def audit_events(events: DataFrame) -> DataFrame:
    """`events` (the fields of EVENT) as a chain for each assessment, with previous_event_hash and event_hash."""
    kept = [name for name in StructType.fromDDL(EVENT).names if name not in ("assessment_id", "sequence_index")]
    plain = events.select("assessment_id", F.col("sequence_index").cast("long"), *kept)
    built = chain.build(plain, "assessment_id", "sequence_index", chain.nested(plain), kept)
    return durable(built.withColumnRenamed("previous_hash", "previous_event_hash"))  # chains are folded once, however often the events are read


def _pages(rows: DataFrame, part: str, page: int) -> DataFrame:
    """(assessment_id, part, page, rows, payload, digest) of a table's rows in the order of its key, as a table that is written.

    A range of the order holds whole pages but for those at its ends, so that rows are shuffled once, and behind that only pieces of pages.
    """
    schema, key = PARTS[part]
    kind = StructType.fromDDL(schema)
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields]
    named = rows.select(F.col("assessment_id").cast("string").alias("run"), F.col(key).alias("at"), F.struct(*fields).alias("r"))
    # equal keys lie in one range, so that the texts can be made behind the shuffle
    texts = named.repartitionByRange("run", "at").select("run", "at", canonical_value(F.col("r"), kind).alias("body"))
    ordered = in_groups(numbered(durable(in_parts(texts, ["run", "at", "body"])), "__at"), "run")
    number = F.floor(F.col("__place") / page)
    left = F.least(F.lit(page), F.col("__n") - number * page)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows that follow each other in a page; what a batch ends with is held back."""
        held: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, of = batch["place"].to_numpy(), batch["page"].to_numpy()
            run = batch["run"].dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.nonzero((np.diff(place) != 1) | (np.diff(of) != 0) | (np.diff(run) != 0))[0] + 1, [len(place)]])
            bodies = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), batch["body"]), ",").to_pylist()
            out = []
            for text, at, end in zip(bodies, starts[:-1].tolist(), starts[1:].tolist()):
                piece = [batch["run"][at].as_py(), int(of[at]), int(place[at]), end - at, int(batch["due"][at].as_py()), [text]]
                if held is not None and held[:2] == piece[:2] and held[2] + held[3] == piece[2]:
                    held[3] += piece[3]
                    held[5].append(text)
                else:
                    if held is not None:
                        out.append(held)
                    held = piece
            yield _pieces(out)
        if held is not None:
            yield _pieces([held])

    kinds = "assessment_id string, page int, at long, rows long, whole boolean, payload string"
    placed = ordered.select("run", number.cast("int").alias("page"), F.col("__place").alias("place"), left.alias("due"), "body")
    digest = F.sha2("payload", 256)
    pieces = durable(placed.mapInArrow(joined, kinds).withColumn("digest", F.when(F.col("whole"), digest)), FILE_PAGES)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "payload"))), lambda x: x["payload"])
    parts = pieces.filter("not whole").groupBy("assessment_id", "page").agg(F.sum("rows").alias("rows"), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("payload"))
    met = durable(parts.withColumn("digest", digest), FILE_PAGES)
    names = ["assessment_id", F.lit(part).alias("part"), "page", "rows", "payload", "digest"]
    return pieces.filter("whole").select(*names).unionByName(met.select(*names))


def _pieces(held: list[list]) -> pa.RecordBatch:
    """Pieces of pages as rows; a page that is whole gets its brackets."""
    rows = [(run, page, at, n, n == due, f"[{','.join(texts)}]" if n == due else ",".join(texts)) for run, page, at, n, due, texts in held]
    kinds = {"assessment_id": pa.string(), "page": pa.int32(), "at": pa.int64(), "rows": pa.int64(), "whole": pa.bool_(), "payload": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())], list(kinds))


def assemble(runs: DataFrame, findings: DataFrame, checks: DataFrame, coverage: DataFrame, events: DataFrame, page: int = PAGE) -> DataFrame:
    """(assessment_id, part, page, payload, digest): the documents of each run of `runs` (assessment_id, assessment_timestamp).

    The other tables have assessment_id and the fields of their part; `events` come from audit_events. The root is the part "root".
    All documents are written when this returns.
    """
    runs = durable(runs)  # so that Spark knows whether they are few enough to go to all tasks
    tables = {"findings": findings, "checks": checks, "coverage": coverage, "events": events}
    pages = [_pages(rows.join(runs.select("assessment_id"), "assessment_id", "left_semi"), part, page) for part, rows in tables.items()]
    parts = pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])
    listed = parts.groupBy("assessment_id").agg(F.array_sort(F.collect_list(F.struct("part", "page", "rows", "digest"))).alias("parts"))
    overall = governance.overall(findings, "assessment_id").select("assessment_id", F.struct("overall_status", "disposition").alias("overall_assessment"))
    unknown = F.struct(F.lit("NOT_ASSESSED").alias("overall_status"), F.lit("REVIEW").alias("disposition"))
    root = runs.select("assessment_id", F.col("assessment_timestamp").cast("string")).join(overall, "assessment_id", "left").join(listed, "assessment_id", "left")
    none = F.array().cast(root.schema["parts"].dataType)
    root = root.withColumns({"overall_assessment": F.coalesce("overall_assessment", unknown), "parts": F.coalesce("parts", none), "schema_version": F.lit(SCHEMA_VERSION)})
    kind = StructType.fromDDL(ROOT)
    plain = root.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields))
    written = durable(plain.select("assessment_id", F.lit("root").alias("part"), F.lit(0).alias("page"), canonical(plain).alias("payload")).withColumn("digest", F.sha2("payload", 256)), FILE_PAGES)
    return parts.drop("rows").unionByName(written)


def read(documents: DataFrame, part: str, *fields: str) -> DataFrame:
    """The rows of a part, with the assessment and the page that they come from as __run and __page. A page that is no such JSON gives none.

    With `fields` only these are read.
    """
    schema = ", ".join(x for x in PARTS[part][0].split(", ") if not fields or x.split()[0] in fields)
    rows = documents.filter(F.col("part") == part).select(F.col("assessment_id").alias("__run"), F.col("page").alias("__page"), F.explode(F.from_json("payload", f"array<struct<{_struct(schema)}>>")).alias("r"))
    return rows.select("__run", "__page", "r.*")


def _struct(ddl: str) -> str:
    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def problems(documents: DataFrame, evidence: DataFrame | None = None, signed: DataFrame | None = None) -> DataFrame:
    """(assessment_id, part, page, problem, detail): all that is wrong with reports, from their documents alone.

    `evidence` (evidence_hash, payload) has what the findings are bound to; `signed` (assessment_id, digest) the roots' digests
    as they were signed or registered elsewhere, without which a report that was written anew as a whole can't be told.
    """
    rooted = documents.filter("part = 'root'").withColumn("root", F.from_json("payload", ROOT))
    found = [rooted.filter(~F.sha2("payload", 256).eqNullSafe(F.col("digest"))).select("assessment_id", "part", "page", F.lit("changed").alias("problem"), F.lit("root").alias("detail"))]
    found.append(rooted.filter(F.col("root.parts").isNull() | ~F.coalesce(F.col("root.assessment_id") == F.col("assessment_id"), F.lit(False))).select("assessment_id", "part", "page", F.lit("unreadable").alias("problem"), F.lit("root").alias("detail")))
    if signed is not None:
        known = signed.select("assessment_id", F.col("digest").alias("signed"))
        own = known.join(rooted.select("assessment_id", F.sha2("payload", 256).alias("now")), "assessment_id", "left").filter(~F.col("signed").eqNullSafe(F.col("now")))
        found.append(own.select("assessment_id", F.lit("root").alias("part"), F.lit(0).alias("page"), F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"), F.lit("signed digest").alias("detail")))
    listed = rooted.select("assessment_id", F.explode("root.parts").alias("p")).select("assessment_id", "p.*").withColumnRenamed("digest", "listed")
    there = documents.filter("part <> 'root'").select("assessment_id", "part", "page", F.sha2("payload", 256).alias("now"))
    met = listed.join(there, ["assessment_id", "part", "page"], "full_outer").filter(~F.col("listed").eqNullSafe(F.col("now")))
    found.append(met.select("assessment_id", "part", "page", F.when(F.col("now").isNull(), "missing").when(F.col("listed").isNull(), "not listed").otherwise("changed").alias("problem"), F.lit("page").alias("detail")))

    missing = [F.when(F.col(name).isNull(), F.lit(f"{name} missing")) for name in ("finding_id", "asset_id", "title", "category", "status", "severity", "disposition")]
    outside = [F.when(F.col(name).isNotNull() & ~F.col(name).isin(*words), F.concat(F.lit(f"{name} "), F.col(name))) for name, words in (("category", CATEGORIES), ("status", STATUSES), ("severity", SEVERITIES), ("disposition", DISPOSITIONS))]
    wide = F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence range"))
    bad = F.array_compact(F.array(*missing, *outside, wide)).alias("bad")
    bound_by = ["evidence_hash"] if evidence is not None else []
    read_ = read(documents, "findings", "finding_id", "asset_id", "title", "category", "status", "severity", "disposition", "confidence", *bound_by)
    # pages are parsed once, and what is kept of them is what the checks below need
    rows = durable(read_.select("__run", "__page", "finding_id", "status", "severity", "disposition", *bound_by, bad))
    formed = rows.filter(F.size("bad") > 0).select("__run", "__page", F.explode("bad").alias("detail"))
    found.append(formed.select(F.col("__run").alias("assessment_id"), F.lit("findings").alias("part"), F.col("__page").alias("page"), F.lit("form").alias("problem"), "detail"))
    if evidence is not None:
        bound = chain.unbound(rows.filter(F.length("evidence_hash") > 0).select("__run", "__page", "finding_id", "evidence_hash"), evidence)
        found.append(bound.select(F.col("__run").alias("assessment_id"), F.lit("evidence").alias("part"), F.col("__page").alias("page"), "problem", F.col("finding_id").alias("detail")))
    said = rooted.select("assessment_id", "root.overall_assessment.*")
    again = governance.overall(rows.withColumnRenamed("__run", "assessment_id"), "assessment_id").select("assessment_id", F.col("overall_status").alias("status"), F.col("disposition").alias("decided"))
    judged = said.join(again, "assessment_id", "left").filter(~F.col("overall_status").eqNullSafe(F.coalesce("status", F.lit("NOT_ASSESSED"))) | ~F.col("disposition").eqNullSafe(F.coalesce("decided", F.lit("REVIEW"))))
    found.append(judged.select("assessment_id", F.lit("root").alias("part"), F.lit(0).alias("page"), F.lit("overall").alias("problem"), F.concat_ws(" ", "overall_status", "disposition").alias("detail")))
    events = read(documents, "events").drop("__page").withColumnRenamed("previous_event_hash", "previous_hash")
    form = chain.nested(events.drop("__run", "previous_hash", "event_hash"))
    broken = chain.verify(events, "__run", "sequence_index", form).filter("not valid")
    found.append(broken.select(F.col("__run").alias("assessment_id"), F.lit("events").alias("part"), F.lit(None).cast("int").alias("page"), F.concat(F.lit("chain "), "first_error").alias("problem"), F.col("at").cast("string").alias("detail")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def verify(documents: DataFrame, evidence: DataFrame | None = None, signed: DataFrame | None = None) -> DataFrame:
    """(assessment_id, verdict, problems, parts, first): VALID or TAMPERED for each report, with the number of problems and the first of them."""
    wrong = problems(documents, evidence, signed).groupBy("assessment_id").agg(F.count("*").alias("problems"), F.min(F.struct("part", "page", "problem", "detail")).alias("first"))
    held = documents.groupBy("assessment_id").agg(F.count("*").alias("parts"), F.count_if(F.col("part") == "root").alias("roots"))
    joined = held.join(wrong, "assessment_id", "full_outer")
    good = F.col("problems").isNull() & (F.col("roots") == 1)
    return joined.select("assessment_id", F.when(good, "VALID").otherwise("TAMPERED").alias("verdict"), F.coalesce("problems", F.lit(0)).alias("problems"), F.coalesce("parts", F.lit(0)).alias("parts"), "first")
