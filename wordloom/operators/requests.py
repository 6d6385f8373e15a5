"""Embedding requests and response documents.

A request body is JSON ``{"input": str | [str, ...], "model": str}``.  One
request is one row (as one HTTP body is one message), so regrouping a
request's texts is bounded by the request itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MODEL_NAME


def request_bodies(texts: DataFrame, key: Sequence[str], order_col: str, text_col: str = "text",
                   model: str = MODEL_NAME) -> DataFrame:
    """Build request bodies from text rows: the texts of a key, in ``order_col``
    order.  A request with a single text sends it as a plain string."""
    key = list(key)
    grouped = texts.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                             F.col(text_col).alias("t")))).alias("_l"))
    inputs = F.transform("_l", lambda x: x["t"])
    body = F.when(F.size(inputs) == 1,
                  F.to_json(F.struct(F.element_at(inputs, 1).alias("input"), F.lit(model).alias("model"))))\
        .otherwise(F.to_json(F.struct(inputs.alias("input"), F.lit(model).alias("model"))))
    return grouped.select(*key, body.alias("body"))


def parse_request(body: Column) -> Column:
    """A2: ``struct<inputs array<string>, model string, error string>``.

    ``input`` may be a string (becomes a list of one) or a list of strings;
    anything else (missing, numbers, nested values) is an error, never coerced.
    ``model`` may be left out; if given it must be a string.
    """
    v = F.try_parse_json(body)
    inp = F.try_variant_get(v, "$.input", "variant")
    kind = F.schema_of_variant(inp)
    as_list = F.try_variant_get(v, "$.input", "array<variant>")
    all_strings = F.forall(as_list, lambda x: F.schema_of_variant(x) == F.lit("STRING"))
    inputs = (F.when(kind == "STRING", F.array(F.try_variant_get(v, "$.input", "string")))
              .when(kind.startswith("ARRAY") & all_strings,
                    F.try_variant_get(v, "$.input", "array<string>")))
    named = F.try_variant_get(v, "$.model", "variant")
    is_text = F.coalesce(F.schema_of_variant(named) == "STRING", F.lit(False))
    # a JSON null is a value of its own: only a body without the field takes the default
    has_model = F.coalesce(F.array_contains(F.json_object_keys(body), "model"), F.lit(False))
    model = F.when(is_text, F.try_variant_get(v, "$.model", "string")).otherwise(F.lit(MODEL_NAME))
    error = (F.when(v.isNull(), "invalid json")
             .when(inp.isNull(), "missing input")
             .when(inputs.isNull(), "input must be a string or a list of strings")
             .when(F.size(inputs) == 0, "input must not be empty")
             .when(has_model & ~is_text, "model must be a string"))
    return F.struct(inputs.alias("inputs"), model.alias("model"), error.alias("error"))


def explode_requests(requests: DataFrame, key: Sequence[str], body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """A2 + B1: -> (texts ``(*key, model, index, text)``, rejects ``(*key, error)``).
    ``index`` is the position in the request's list."""
    key = list(key)
    parsed = requests.select(*key, parse_request(F.col(body_col)).alias("r"))
    rejects = parsed.where(F.col("r.error").isNotNull()).select(*key, F.col("r.error").alias("error"))
    texts = (parsed.where(F.col("r.error").isNull())
             .select(*key, F.col("r.model").alias("model"),
                     F.posexplode("r.inputs").alias("index", "text")))
    return texts, rejects


def assemble_responses(results: DataFrame, key: Sequence[str], index_col: str = "index",
                       vec_col: str = "embedding", tokens_col: str = "n_tokens",
                       model_col: str = "model") -> DataFrame:
    """E2 + E1: regroup a request's results in index order (batches mix
    requests) -> ``(*key, model, data array<struct<object,index,embedding>>,
    prompt_tokens, total_tokens)``."""
    key = list(key)
    g = results.groupBy(*key).agg(
        F.first(model_col).alias("model"),
        F.array_sort(F.collect_list(F.struct(
            F.col(index_col).cast("long").alias("index"), F.col(vec_col).alias("embedding")))).alias("_d"),
        F.sum(tokens_col).cast("long").alias("total_tokens"))
    data = F.transform("_d", lambda x: F.struct(F.lit("embedding").alias("object"),
                                                x["index"].alias("index"), x["embedding"].alias("embedding")))
    return g.select(*key, "model", data.alias("data"),
                    F.col("total_tokens").alias("prompt_tokens"), "total_tokens")


def response_json(responses: DataFrame, key: Sequence[str]) -> DataFrame:
    """One JSON document per request (``object: "list"``)."""
    doc = F.to_json(F.struct(
        F.lit("list").alias("object"), F.col("data"), F.col("model"),
        F.struct(F.col("prompt_tokens"), F.col("total_tokens")).alias("usage")))
    return responses.select(*key, doc.alias("response"))


def restore_order(texts: DataFrame, key: Sequence[str], index_col: str = "index") -> DataFrame:
    """Rows in request order, then input order (a range-partitioned sort)."""
    return texts.orderBy(*key, index_col)
