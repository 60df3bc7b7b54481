"""Serving tables: canonical forecasts, the product registry, resolution of product names, look-ups and display frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import contains_words, is_blank, normalize_text, product_key
from tallyloom.operators import names
from tallyloom.operators.panel import gap_filled_weeks
from tallyloom.operators.prep import top_values
from tallyloom.session import materialize
from tallyloom.sources.tables import FORECAST_SCHEMA, exists, read_table, write_table

#: Model of each cluster: id, name, prediction column, probability column. Fixed values.
MODELS = {0: ("c0_two_stage", "Two-stage boosted trees", "pred_two_stage_lgbm", "p_sale"), 1: ("c1_zinb", "ZINB", "pred_zinb", "p_sale"), 2: ("c2_global", "Global boosted trees", "pred_global_lgbm", None), 3: ("c3_two_stage", "Two-stage boosted trees", "pred_two_stage", "p_sale")}
MATCH, MARGIN = 0.55, 0.12
DEFAULT_HORIZON, LONGEST_HORIZON = 14, 90


def validate_forecast(df: DataFrame) -> DataFrame:
    """df if it has the canonical columns, rows, and a forecast; else an error. One small aggregate."""
    missing = [c for c in FORECAST_SCHEMA.names if c not in df.columns]
    if missing:
        raise ValueError(f"canonical forecast lacks columns: {missing}")
    rows, known = df.agg(F.count("*"), F.count("forecast_value")).first()
    if not rows or not known:
        raise ValueError("canonical forecast has no rows" if not rows else "canonical forecast has no forecast values")
    return df


def canonical(pred: DataFrame, cluster: int, generated_at: str, metadata: DataFrame | None = None, models: dict | None = None) -> DataFrame:
    """A prediction frame in the canonical columns (and actual_value where it has y), ids from metadata."""
    model_id, model_name, column, probability = (models or MODELS)[cluster]
    if "sku_id" in pred.columns and "product_family_name" not in pred.columns:
        pred = pred.withColumnRenamed("sku_id", "product_family_name")
    missing = [c for c in ("date", "product_family_name", column) if c not in pred.columns]
    if missing:
        raise ValueError(f"prediction frame of cluster {cluster} lacks columns: {missing}")
    name = F.trim(F.coalesce("product_family_name", F.lit("")))
    rows = pred.withColumn("product_family_name", name)
    if metadata is not None:
        ids = metadata.groupBy("product_family_name").agg(F.min("product_id").alias("product_id"))
        rows = rows.drop("product_id").join(ids, "product_family_name", "left")
    else:
        rows = rows.withColumn("product_id", F.lit(None).cast("string"))
    out = {
        "product_key": product_key(F.lit(cluster), F.col("product_family_name")), "product_family_name": F.col("product_family_name"), "product_id": F.col("product_id"), "cluster": F.lit(cluster),
        "model_id": F.lit(model_id), "model_name": F.lit(model_name), "forecast_date": F.to_date("date"), "forecast_value": F.col(column).cast("double"),
        "p_sale": F.col(probability).cast("double") if probability and probability in pred.columns else F.lit(None).cast("double"), "generated_at": F.lit(generated_at),
    }
    extra = [F.col("y").cast("double").alias("actual_value")] if "y" in pred.columns else []
    return rows.select(*[c.alias(n) for n, c in out.items()], *extra)


def write_asset(df: DataFrame, path: str) -> DataFrame:
    """df's canonical columns written at path (by suffix) and read again; an error unless the rows that are read are those that were written (an aggregate of
    their hashes on either side)."""
    kept = materialize(validate_forecast(df).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FORECAST_SCHEMA]), "asset")
    write_table(kept, path)
    back = validate_forecast(read_table(df.sparkSession, path, FORECAST_SCHEMA))
    told = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64(*FORECAST_SCHEMA.names).cast("decimal(38,0)"))).first()
    if told(kept) != told(back):
        raise ValueError(f"what was read at {path} isn't what was written")
    return back


def observed_history(spark: SparkSession, path: str, product: str | None = None, days: int | None = None) -> DataFrame:
    """sku, date and y of a stored panel, of one product (null or blank: of all) and of the last so many days that the product has; no rows where nothing is stored at path."""
    schema = "sku string, date date, y double"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = read_table(spark, path).select(F.col("sku").cast("string").alias("sku"), F.to_date("date").alias("date"), F.col("y").cast("double").alias("y"))
    rows = rows if product is None or not product.strip() else rows.where(F.col("sku") == product.strip())
    if days is None:
        return rows
    last = rows.groupBy("sku").agg(F.date_sub(F.max("date"), days).alias("__after"))
    return rows.join(last, "sku").where(F.col("date") > F.col("__after")).drop("__after")


def product_metadata(tx: DataFrame, family: str = "product_family_name", code: str = "stock_code", desc: str = "description", order: str = "invoice") -> DataFrame:
    """Per family: its most frequent code as id, aliases (name, codes, descriptions), and descriptions."""
    codes, descriptions = top_values(tx, family, code, order).withColumnRenamed("top", "codes"), top_values(tx, family, desc, order).withColumnRenamed("top", "description_examples")
    joined = tx.where(~is_blank(F.col(family))).select(family).distinct().join(codes, family, "left").join(descriptions, family, "left")
    none = F.array().cast("array<string>")
    aliases = F.concat(F.array(family), F.coalesce("codes", none), F.coalesce("description_examples", none))
    norm = F.array_sort(F.array_distinct(F.filter(F.transform(aliases, normalize_text), lambda a: a != "")))
    return joined.select(
        F.col(family).alias("product_family_name"), normalize_text(F.col(family)).alias("normalized_product_name"), F.get("codes", F.lit(0)).alias("product_id"),
        normalize_text(F.get("codes", F.lit(0))).alias("product_id_norm"), aliases.alias("search_aliases"), norm.alias("search_aliases_norm"), F.coalesce("description_examples", none).alias("description_examples"),
    )


def registry(forecasts: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per product_key: first values by date, latest build, and what metadata knows."""
    first = [F.min_by(c, "forecast_date").alias(c) for c in ("product_family_name", "product_id", "cluster", "model_id", "model_name")]
    latest = forecasts.groupBy("product_key").agg(*first, F.max("generated_at").alias("generated_at"))
    m = metadata.withColumnsRenamed({"product_id": "__id"})
    joined = latest.join(m, "product_family_name", "left")
    none = F.array().cast("array<string>")
    pid = F.coalesce("product_id", "__id")
    return joined.select(
        "product_key", "product_family_name", F.coalesce("normalized_product_name", normalize_text(F.col("product_family_name"))).alias("normalized_product_name"), pid.alias("product_id"),
        F.coalesce("product_id_norm", normalize_text(pid)).alias("product_id_norm"), "cluster", "model_id", "model_name", "generated_at",
        F.coalesce("search_aliases", none).alias("search_aliases"), F.coalesce("search_aliases_norm", none).alias("search_aliases_norm"), F.coalesce("description_examples", none).alias("description_examples"),
    )


def exact_matches(queries: DataFrame, products: DataFrame, key: str = "product_key") -> DataFrame:
    """query, status and keys by the first rule that matches anything: id, then name, then alias. Equality joins only."""
    asked = queries.select("query", normalize_text(F.col("query")).alias("norm")).where("norm <> ''")
    rules = (
        products.select(F.lit(1).alias("rule"), F.col("product_id_norm").alias("norm"), key),
        products.select(F.lit(2).alias("rule"), F.col("normalized_product_name").alias("norm"), key),
        products.select(F.lit(3).alias("rule"), F.explode("search_aliases_norm").alias("norm"), key),
    )
    known = rules[0].unionByName(rules[1]).unionByName(rules[2]).distinct()
    found = asked.join(known, "norm").groupBy("query", "rule").agg(F.array_sort(F.collect_set(key)).alias("keys"))
    best = found.groupBy("query").agg(F.min_by(F.struct("rule", "keys"), "rule").alias("b"))
    out = queries.select("query").distinct().join(best, "query", "left")
    return out.select("query", F.when(F.col("b").isNull(), "not_found").when(F.size("b.keys") == 1, "resolved").otherwise("ambiguous").alias("status"), F.coalesce("b.keys", F.array().cast("array<string>")).alias("keys"))


def asked_names(queries: DataFrame) -> DataFrame:
    """query and norm of the distinct queries that have anything left when normalised."""
    return queries.select("query", normalize_text(F.col("query")).alias("norm")).where("norm <> ''").distinct()


def fuzzy_ranks(queries: DataFrame, products: DataFrame, limit: int = 5, key: str = "product_key") -> DataFrame:
    """query, key, score, rank of the best products by name, id and aliases, and how many pairs took the exact ratio."""
    return names.ranked(asked_names(queries), products, limit, key)


def loosely(queries: DataFrame, products: DataFrame, key: str = "product_key") -> DataFrame:
    """query, status, keys and nearest by the fuzzy ranking: resolved if its best is good and clear, ambiguous if good, else not found, with
    the closest names. Only queries that anything matches well are ranked."""
    hopeful = names.reaching(asked_names(queries), products, MATCH, key)
    ranked = names.ranked(hopeful, products, key=key).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", key))), lambda s: F.struct(s["score"].alias("s"), s[key].alias("k"))).alias("r"))
    top, second = F.get("r", F.lit(0))["s"], F.get("r", F.lit(1))["s"]
    status = F.when(F.col("r").isNull() | (top < MATCH), "not_found").when(second.isNull() | (top - second >= MARGIN), "resolved").otherwise("ambiguous")
    rows = materialize(queries.join(ranked, "query", "left").select("query", status.alias("status"), F.transform(F.coalesce("r", F.array().cast("array<struct<s:double,k:string>>")), lambda x: x["k"]).alias("k")), "loosely")
    close = names.nearest(asked_names(rows.where("status = 'not_found'")), products, key=key)
    none = F.array().cast("array<string>")
    keys = F.when(F.col("status") == "resolved", F.slice("k", 1, 1)).when(F.col("status") == "ambiguous", F.col("k")).otherwise(none)
    return rows.join(close, "query", "left").select("query", "status", keys.alias("keys"), F.coalesce("nearest", none).alias("nearest"))


def resolve(queries: DataFrame, products: DataFrame, key: str = "product_key") -> DataFrame:
    """The whole cascade: exact rules, then the fuzzy ranking over what is left. products is read several times."""
    exact = materialize(exact_matches(queries, products, key), "exact")
    loose = loosely(exact.where("status = 'not_found'").select("query"), products, key)
    return exact.where("status <> 'not_found'").withColumn("nearest", F.array().cast("array<string>")).unionByName(loose)


def unavailable(queries: DataFrame, listed: DataFrame) -> DataFrame:
    """query and the one listed product that it names: by id, name or alias, else by words inside the query (of four letters at least)."""
    by_rule = exact_matches(queries, listed, "product_family_name").where("status = 'resolved'").select("query", F.get("keys", F.lit(0)).alias("product_family_name"))
    words = listed.select("product_family_name", F.explode(F.array_distinct(F.concat(F.array("normalized_product_name", "product_id_norm"), "search_aliases_norm"))).alias("c")).where("length(c) >= 4").withColumn("t", F.element_at(F.split("c", " "), 1))
    asked = queries.select("query", normalize_text(F.col("query")).alias("norm")).join(by_rule, "query", "left_anti").distinct()
    inside = asked.withColumn("t", F.explode(F.array_distinct(F.split("norm", " ")))).join(words, "t").where(contains_words(F.col("norm"), F.col("c")))
    one = inside.groupBy("query").agg(F.collect_set("product_family_name").alias("f")).where("size(f) = 1").select("query", F.get("f", F.lit(0)).alias("product_family_name"))
    return by_rule.unionByName(one).join(listed.select("product_family_name", "reason_type"), "product_family_name")


def lookup(forecasts: DataFrame, keys: DataFrame, horizon: int) -> DataFrame:
    """The first days of each wanted product's forecast."""
    rn = F.row_number().over(Window.partitionBy("product_key").orderBy("forecast_date"))
    return forecasts.join(keys, "product_key", "left_semi").withColumn("rn", rn).where(F.col("rn") <= horizon).drop("rn")


def display_weekly(forecasts: DataFrame) -> DataFrame:
    """Weeks from Monday on: summed forecasts and actuals (0 in gaps), mean probabilities (null in gaps)."""
    rows = forecasts.select(F.col("product_key").alias("sku"), F.col("forecast_date").alias("date"), "forecast_value", "actual_value", "p_sale")
    weeks = gap_filled_weeks(rows, {"forecast_value": F.col("forecast_value"), "actual_value": F.col("actual_value")}, {"p_sale": F.col("p_sale")})
    return weeks.withColumnRenamed("sku", "product_key")


def chart(history: DataFrame, forecasts: DataFrame) -> DataFrame:
    """product_key, date, segment, actual_value, forecast_value: history, then forecast."""
    past = history.select("product_key", "date", F.lit("history").alias("segment"), F.col("y").alias("actual_value"), F.lit(None).cast("double").alias("forecast_value"))
    return past.unionByName(forecasts.select("product_key", F.col("forecast_date").alias("date"), F.lit("forecast").alias("segment"), "actual_value", "forecast_value"))


def summary(forecasts: DataFrame) -> DataFrame:
    """A row per product: days, total, mean, first, last, days without demand, mean probability of a sale, trend, and these as a sentence."""
    a, b = F.min_by("forecast_value", "forecast_date"), F.max_by("forecast_value", "forecast_date")
    rows = forecasts.groupBy("product_key").agg(
        F.count("*").alias("n_days"), F.sum("forecast_value").alias("total"), F.avg("forecast_value").alias("mean"), a.alias("first"), b.alias("last"),
        F.count_if(F.col("forecast_value") == 0).alias("zero_days"), F.avg("p_sale").alias("p_sale"),
    )
    trend = F.when(F.col("last") > F.col("first") * 1.1, "upward").when(F.col("first") > F.col("last") * 1.1, "downward").otherwise("stable")
    told = F.format_string("%d days: %.2f in total, %.2f a day, from %.2f to %.2f, %s; %d days without demand", F.col("n_days").cast("int"), "total", "mean", "first", "last", trend, F.col("zero_days").cast("int"))
    chance = F.coalesce(F.format_string("; a sale on %.0f %% of days", F.col("p_sale") * 100), F.lit(""))
    return rows.withColumn("trend", trend).withColumn("summary", F.concat(told, F.when(F.col("p_sale").isNull(), "").otherwise(chance)))


#: Words of a request that are no part of a product's name.
REQUEST_VERBS = ("show", "give", "tell", "get")
REQUEST_WORDS = ("weekly", "daily", "forecast", "latest", "future", "next", "product", "for", "about")
UNITS = r"^(?:days?|weeks?|months?|[dwm])$"


def parse_requests(queries: DataFrame) -> DataFrame:
    """query, horizon_days, granularity and product_query of requests in plain words. A number of days goes before weeks, these before
    months; the product is a stated code, else what is quoted, else the words that are left: those that are no number with its unit, no
    request word, no verb with its "me" at the beginning, and no article before them."""
    q = F.trim(F.coalesce("query", F.lit("")))
    low = F.lower(q)
    number = lambda unit: F.nullif(F.regexp_extract(low, rf"(\d+)\s*{unit}\b", 1), F.lit("")).try_cast("int")
    days, weeks, months = number("(?:days?|d)"), number("(?:weeks?|w)"), number("(?:months?|m)")
    horizon = F.coalesce(days, weeks * 7, months * 30, F.lit(DEFAULT_HORIZON))
    grain = F.when(low.rlike(r"weekly|per week"), "weekly").when(low.rlike(r"daily|per day"), "daily").when(days.isNull() & weeks.isNotNull(), "weekly").otherwise("daily")
    told = queries.select("query", F.least(F.greatest(horizon, F.lit(1)), F.lit(LONGEST_HORIZON)).alias("horizon_days"), grain.alias("granularity"), F.filter(F.split(F.regexp_replace(q, "[,:;?#]", " "), r"\s+"), lambda t: t != "").alias("t"), F.get(F.split(q, "[\"']"), F.lit(1)).alias("quoted"), F.size(F.split(q, "[\"']")).alias("quotes"))
    word = lambda k: F.lower(F.coalesce(F.get("t", k), F.lit("")))
    names_code = lambda t, i: (F.lower(t).isin("id", "stockcode") | ((F.lower(t) == "code") & (word(i - 1) == "stock"))) & F.coalesce(F.get("t", i + 1), F.lit("")).rlike("(?i)^[A-Z0-9][A-Z0-9-]*")
    at = F.get(F.filter(F.transform("t", lambda t, i: F.when(names_code(t, i), i + 1)), lambda k: k.isNotNull()), F.lit(0))
    code = F.regexp_extract(F.get("t", at), "(?i)^[A-Z0-9][A-Z0-9-]*", 0)

    def unneeded(t: Column, i: Column) -> Column:
        own, after, before = F.lower(t), word(i + 1), word(i - 1)
        counted = own.rlike(r"^\d+(?:days?|weeks?|months?|[dwm])$") | (own.rlike(r"^\d+$") & after.rlike(UNITS)) | (own.rlike(UNITS) & before.rlike(r"^\d+$"))
        asking = own.isin(*REQUEST_WORDS) | ((own == "per") & after.isin("week", "day")) | (own.isin("week", "day") & (before == "per"))
        leading = (own.isin(*REQUEST_VERBS) & (after == "me") & (i <= 3)) | ((own == "me") & before.isin(*REQUEST_VERBS) & (i <= 4)) | ((i == 0) & (own == "please")) | ((i <= 2) & (own.isin("can", "you")) & (after.isin("you", *REQUEST_VERBS)))
        return counted | asking | leading | ((own == "the") & (after == "next"))

    left = F.filter("t", lambda t, i: ~unneeded(t, i))
    rest = told.withColumns({"code": code, "left": left})
    article = lambda t: F.lower(t).isin("a", "an", "the")
    begin = F.coalesce(F.get(F.filter(F.transform("left", lambda t, i: F.when(~article(t), i)), lambda k: k.isNotNull()), F.lit(0)), F.size("left"))
    bare = F.regexp_replace(F.array_join(F.slice("left", begin + 1, F.greatest(F.size("left"), F.lit(1))), " "), r"[\s-]+$", "")
    product = F.coalesce(F.nullif("code", F.lit("")), F.when(F.col("quotes") > 2, F.nullif("quoted", F.lit(""))), bare)
    return rest.select("query", "horizon_days", "granularity", product.alias("product_query"))


def answer(queries: DataFrame, products: DataFrame, listed: DataFrame) -> DataFrame:
    """query, status, keys, nearest: exact resolution, then the list of unavailable products, then the fuzzy one; each step takes what is left."""
    none = F.array().cast("array<string>")
    strict = materialize(exact_matches(queries, products), "strict")
    rest = strict.where("status = 'not_found'").select("query")
    gone = materialize(unavailable(rest, listed).select("query", F.lit("unavailable").alias("status"), F.array("product_family_name").alias("keys")), "unavailable")
    loose = loosely(rest.join(gone, "query", "left_anti"), products)
    return strict.where("status <> 'not_found'").unionByName(gone).withColumn("nearest", none).unionByName(loose)
