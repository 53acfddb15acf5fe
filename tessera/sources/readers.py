"""Scans: JSON lines and documents, keyed objects, checkpoint folders, nested works, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X

#: A work as its provider nests it.
WORK = (
    "id string, title string, publication_year int, cited_by_count long, "
    "authorships array<struct<author: struct<display_name: string>>>, concepts array<struct<display_name: string>>, "
    "abstract_inverted_index map<string, array<int>>, doi string, "
    "primary_location struct<landing_page_url: string, source: struct<display_name: string>>, referenced_works array<string>"
)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_object(df: DataFrame, column: str, value_type: str) -> DataFrame:
    """key and value of a column that holds an object of objects."""
    return df.select(F.explode(F.from_json(column, f"map<string, {value_type}>")).alias("key", "value"))


def flatten_works(works: DataFrame) -> DataFrame:
    """One flat row per work: joined names, first five concepts, text of the abstract, bare ids."""
    names = lambda a: F.transform(a, lambda x: x["author"]["display_name"])
    landing = F.col("primary_location.landing_page_url")
    return works.select(
        F.regexp_replace("id", "^https?://[^/]+/", "").alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(names(F.col("authorships")), F.array().cast("array<string>")).alias("authors"),
        X.from_inverted_index(F.col("abstract_inverted_index")).alias("abstract"),
        F.col("publication_year").alias("year"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.array_join(F.slice(F.transform("concepts", lambda c: c["display_name"]), 1, 5), ", ").alias("categories"),
        X.norm_doi(F.col("doi")).alias("doi"),
        F.coalesce("primary_location.source.display_name", F.lit("")).alias("venue"),
        F.when(F.contains(landing, F.lit("arxiv.org")), X.preprint_id(F.element_at(F.split(landing, "/"), -1))).alias("arxiv_id"),
        F.transform("referenced_works", lambda r: F.regexp_replace(r, "^https?://[^/]+/", "")).alias("edges"),
    )


def compose_text(title: Column, abstract: Column) -> Column:
    """``title. abstract``, or the title alone."""
    return F.when(F.length(F.trim(F.coalesce(abstract, F.lit("")))) > 0, F.concat(F.trim(title), F.lit(". "), F.trim(abstract))).otherwise(F.trim(title))


def resolve_address(url: Column) -> Column:
    """(kind, id) of an address: a provider's work, a preprint, a DOI, or other."""
    work = F.nullif(F.regexp_extract(url, r"openalex\.org/(?:works/)?(W\d+)", 1), F.lit(""))
    preprint = X.preprint_id(F.nullif(F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/([^\s?#]+)", 1), F.lit("")))
    doi = X.doi_in(url)
    kind = F.when(work.isNotNull(), "work").when(preprint.isNotNull(), "preprint").when(doi.isNotNull(), "doi").otherwise("other")
    return F.struct(kind.alias("kind"), F.coalesce(work, preprint, doi).alias("id"))
