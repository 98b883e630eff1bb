"""Search of elements by name, template and category, with relevance, over an inverted index of name grams.

A name's grams are its runs of three letters, in lower case and with a space at both ends. To
share at least so many grams with a query, a name must have one of the query's rarest grams
(all but as many as it may lack), so only those are looked up: grams that most names have, of
whatever length their lists are, aren't read. What is found is confirmed on all grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a met criterion counts.
NAME, TEMPLATE, CATEGORY = 1.0, 1.0, 0.9


def grams(text: Column) -> Column:
    """The distinct grams of a text, sorted; none where it is null or has none."""
    t = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    at = F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1)))
    return F.coalesce(F.when(F.length(t) > 2, F.array_sort(F.array_distinct(F.transform(at, lambda i: F.substring(t, i, F.lit(3)))))), F.array().cast("array<string>"))


def index(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index (gram, id), and how many names have each gram (gram, names)."""
    lists = elements.select("id", F.explode(grams(F.col("name"))).alias("gram"))
    return lists, lists.groupBy("gram").agg(F.count("*").alias("names"))


def search(elements: DataFrame, lists: DataFrame, counts: DataFrame, queries: DataFrame, least: float = 0.6) -> DataFrame:
    """query_id, id, share and relevance of the elements that meet all criteria of a query.

    elements: id, name, template, categories (array). queries: query_id, name, template, category, null where
    that doesn't matter. A name meets the query's if it has at least `least` of its grams (share), templates and
    categories by equality. Relevance is the mean of what the criteria count, the name times its share. A
    query without a name asks by template, or category, alone; one without any criterion finds nothing.
    """
    q = queries.select("query_id", "template", "category", grams(F.col("name")).alias("_g"), F.col("name").isNotNull().alias("_named"))
    need = F.ceil(F.size("_g") * least)
    each = q.where("_named").select("query_id", F.explode("_g").alias("gram"), need.alias("_need"), F.size("_g").alias("_of")).join(counts, "gram", "left")
    rare = Window.partitionBy("query_id").orderBy(F.coalesce("names", F.lit(0)), "gram")
    asked = each.withColumn("_place", F.row_number().over(rare)).where((F.col("_place") <= F.col("_of") - F.col("_need") + 1) & F.col("names").isNotNull()).select("query_id", "gram")
    by_name = asked.join(lists, "gram").select("query_id", "id").distinct()
    e = elements.select("id", grams(F.col("name")).alias("_h"), F.col("template").alias("_template"), "categories")
    named = by_name.join(q, "query_id").join(e, "id")
    unnamed = q.where("not _named")
    by_template = unnamed.where("template is not null").join(e, F.col("template") == F.col("_template"))
    in_category = e.select("id", "_h", "_template", "categories", F.explode(F.array_distinct("categories")).alias("_c"))
    by_category = unnamed.where("template is null and category is not null").join(in_category, F.col("category") == F.col("_c")).drop("_c")
    found = named.unionByName(by_template).unionByName(by_category)
    both = F.when(F.col("_named"), F.size(F.array_intersect("_g", "_h")))
    found = found.withColumn("_both", both).withColumn("share", F.col("_both") / F.size("_g")).where(
        (~F.col("_named") | (F.col("_both") >= need)) & (F.col("template").isNull() | (F.col("template") == F.col("_template")))
        & (F.col("category").isNull() | F.coalesce(F.array_contains("categories", F.col("category")), F.lit(False))))
    asks = F.col("_named").cast("int") + F.col("template").isNotNull().cast("int") + F.col("category").isNotNull().cast("int")
    met = F.coalesce(NAME * F.col("share"), F.lit(0.0)) + F.when(F.col("template").isNotNull(), TEMPLATE).otherwise(0.0) + F.when(F.col("category").isNotNull(), CATEGORY).otherwise(0.0)
    return found.select("query_id", "id", "share", (met / asks).alias("relevance"))


def by_relevance(found: DataFrame, k: int) -> DataFrame:
    """The k most relevant of each query, ties to the smaller id, with their place."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
