"""Exports: NDJSON, CSV rows, and source comments as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_ndjson(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def location_text(locator: Column) -> Column:
    path = F.array_join(locator["heading_path"], " > ")
    parts = [
        F.when(locator["page"].isNotNull(), F.concat(F.lit("page "), locator["page"].cast("string"))),
        F.when(locator["table"].isNotNull(), F.concat(F.lit("table "), locator["table"].cast("string"))),
        F.when(locator["cell_ref"] != "", F.concat(F.lit("row "), locator["cell_ref"])),
        F.when(path != "", F.concat(F.lit("section "), path)),
        F.when(locator["start"].isNull() | locator["end"].isNull(), F.lit("span not located in this section")),
    ]
    return F.concat_ws(", ", *parts)


def source_text(source: Column, number: Column) -> Column:
    """The lines that describe one source."""
    n = F.concat(number.cast("string"), F.lit(". "))
    added = lambda prefix, c: F.coalesce(F.concat(F.lit(prefix), F.nullif(c.cast("string"), F.lit(""))), F.lit(""))
    by = F.concat(n, F.lit("Attested by "), F.coalesce(source["attested_by"], F.lit("a reviewer")), added(" at ", source["at"]), added(": ", source["note"]))
    kinds = F.concat_ws(", ", F.nullif(source["doc_type"], F.lit("")), F.nullif(source["doc_kind"], F.lit("")))
    title = F.concat(
        n,
        F.when(source["source_type"] == "fact", "Fact").otherwise("Source"),
        F.lit(": "),
        F.coalesce(source["document_title"], F.lit("Untitled document")),
        F.when(kinds != "", F.concat(F.lit(" ("), kinds, F.lit(")"))).otherwise(""),
    )
    place = location_text(source["locator"])
    full = F.concat_ws(
        "\n",
        title,
        F.when(source["effective_date"].isNotNull(), F.concat(F.lit("Effective "), source["effective_date"].cast("string"))),
        F.when(place != "", F.concat(F.lit("Location: "), place)),
        F.when(source["quote"] != "", F.concat(F.lit("“"), source["quote"], F.lit("”"))),
    )
    return F.when(source["source_type"] == "human_attestation", by).otherwise(full)


# How support statuses are shown.
SUPPORT_LABELS = {"supported": "supported", "weak": "weak", "unsupported": "unsupported", "human_authored": "human authored", "connective": "connective"}


def source_comment(segment: Column) -> Column:
    """A segment's comment; null for a connective without sources."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SUPPORT_LABELS.items() for x in kv]), segment["support_status"]), segment["support_status"], F.lit("unknown"))
    d = segment["dispute"]
    dispute = F.when(
        d.isNotNull(),
        F.concat(
            F.lit("Disputed by "),
            F.coalesce(d["disputed_by"], F.lit("a reviewer")),
            F.coalesce(F.concat(F.lit(" at "), d["at"].cast("string")), F.lit("")),
            F.coalesce(F.concat(F.lit(": "), d["note"]), F.lit("")),
        ),
    )
    blocks = F.array_join(F.transform(segment["sources"], lambda s, i: source_text(s, i + 1)), "\n\n")
    some = F.coalesce(F.size(segment["sources"]), F.lit(0)) > 0
    text = F.concat_ws("\n", F.concat(F.lit("Support: "), label), dispute, F.when(~some, "No source located for this sentence."), F.when(some, F.concat(F.lit("\n"), blocks)))
    return F.when(some | (segment["kind"] != "connective"), text)
