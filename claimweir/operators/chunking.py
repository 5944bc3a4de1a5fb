"""Sectioned documents to retrieval chunks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweir import fixed
from claimweir.functions.text import strip

# Numbers of more than 18 digits or of other digits than 0-9 fit no long: such a line is plain text.
_HEADER = f"(?iU){fixed.SECTION_HEADER}".replace(r"\d+", "[0-9]{1,18}")


def split_sections(text: Column) -> Column:
    """Array of (section, section_number, body); the body of a preamble or of a whole text is not split further."""

    def part(section, number, body):
        return F.struct(
            section.alias("section"), number.cast("long").alias("section_number"), body.alias("body")
        )

    def found(group):
        return F.regexp_extract_all(text, F.lit(_HEADER), F.lit(group))

    # The text before the first header takes the place of a section without header or number.
    nothing = F.array(F.lit(None).cast("string"))
    pieces = F.arrays_zip(
        F.concat(nothing, found(1)).alias("header"),
        F.concat(nothing, found(2)).alias("number"),
        F.split(text, _HEADER).alias("body"),
    )
    parts = F.transform(
        pieces,
        lambda piece: part(
            F.coalesce(strip(piece["header"]), F.lit(fixed.PREAMBLE_SECTION)),
            F.coalesce(piece["number"], F.lit("0")),
            strip(piece["body"]),
        ),
    )
    kept = F.filter(
        parts, lambda p: (p["section"] != fixed.PREAMBLE_SECTION) | (p["body"] != "")
    )
    whole = F.array(part(F.lit(fixed.WHOLE_SECTION), F.lit(1), strip(text)))
    return F.when(text.rlike(_HEADER), kept).otherwise(whole)


def pack_paragraphs(header: Column, body: Column, size: int = 1000) -> Column:
    """Array of chunk texts: paragraphs joined until the next one would pass `size`, each chunk led by the header.

    Separators do not count, and a chunk always takes one paragraph whatever its length.
    """
    paragraphs = F.filter(
        F.transform(F.split(body, "\n\n"), strip), lambda p: (p != "") & (p != header)
    )
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        header.alias("open"),
        F.char_length(header).alias("length"),
        F.lit(0).alias("taken"),
    )

    def add(state, paragraph):
        length = F.char_length(paragraph)
        full = (state["length"] + length > size) & (state["taken"] > 0)
        separator = F.lit("\n\n")
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"])))
            .otherwise(state["done"])
            .alias("done"),
            F.concat(F.when(full, header).otherwise(state["open"]), separator, paragraph).alias("open"),
            (F.when(full, F.char_length(header)).otherwise(state["length"]) + length).alias("length"),
            F.when(full, 1).otherwise(state["taken"] + 1).alias("taken"),
        )

    return F.aggregate(
        paragraphs, start, add, lambda state: F.concat(state["done"], F.array(state["open"]))
    )


def chunk_documents(documents: DataFrame, size: int = 1000) -> DataFrame:
    """Chunks (chunk_id, text, metadata) of documents (file_name, text, and file_path if there is one).

    Parts are numbered over all sections of one number and all files of one name, by path, so that no id occurs twice.
    No array here is ever empty. The outer forms of explode keep the planner from adding a filter on their size, which
    would split every text twice.
    """
    stem = F.regexp_replace("file_name", r"(?<=[^.])\.[^.]*$", "")
    place = F.col("file_path") if "file_path" in documents.columns else F.xxhash64("text").cast("string")
    sections = documents.select(
        "file_name",
        stem.alias("stem"),
        place.alias("place"),
        F.posexplode_outer(split_sections(F.col("text"))).alias("at", "part"),
    ).select("file_name", "stem", "place", "at", "part.*")
    unsplit = F.col("section").isin(fixed.PREAMBLE_SECTION, fixed.WHOLE_SECTION)
    texts = F.when(unsplit, F.array("body")).otherwise(
        pack_paragraphs(F.col("section"), F.col("body"), size)
    )
    number = F.col("section_number")
    label = (
        F.when(F.col("section") == fixed.PREAMBLE_SECTION, F.lit("_preamble_"))
        .when(F.col("section") == fixed.WHOLE_SECTION, F.lit("_full_"))
        .otherwise(F.concat(F.lit("_sec"), number, F.lit("_part")))
    )
    chunks = sections.select("*", label.alias("label"), F.posexplode_outer(texts).alias("position", "chunk"))
    within = Window.partitionBy("stem", "label").orderBy("place", "at", "position")
    return chunks.withColumn("position", F.row_number().over(within) - 1).select(
        F.concat("stem", "label", "position").alias("chunk_id"),
        F.col("chunk").alias("text"),
        F.struct(
            F.col("file_name").alias("source_file"),
            "section",
            "section_number",
            F.lit(fixed.REGULATORY_BODY).alias("regulatory_body"),
            F.lit(fixed.FRAMEWORK).alias("framework"),
        ).alias("metadata"),
    )
