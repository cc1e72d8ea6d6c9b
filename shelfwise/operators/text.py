"""Text, prompt payloads and vector similarity search.

No remote model is called: the payload datasets a model would receive are built
(T2, T8, T9, T10), keyword extraction is TF-IDF over the corpus (T3), and search
is exact cosine similarity over an ``array<float>`` column (T4, T5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import cosine
from shelfwise.functions.skew import join_split
from shelfwise.operators import similarity
from shelfwise.operators.ranking import materialize

# The keyword-extraction instruction placed before each description.
KEYWORD_INSTRUCTION = ('Given the following product description, identify and list the key features and '
                       'attributes in a comma-separated format. Do not include any other text, except the list: "')
# The customer-recap instruction placed before each customer's JSON.
RECAP_INSTRUCTION = ('Craft a concise summary for customer service representatives, highlighting key customer '
                     'metrics and their comparison to the average, as well as segmentation details and additional '
                     'insights. Ensure its easily digestible for use during sales calls. 0 on quartiles means not '
                     'eligible.  The result will be dumped to display on a dashboard, so make sure it is formatted '
                     'well.')
# The return-email constants.
EMAIL_OFFER = "30% off 1 Item"
EMAIL_COUPON = "Qx2V3mW8FjCt"
EMAIL_REP = "Adam"
EMAIL_COMPANY = "Adventure Works"
# Stop words (English, French, Spanish, German function words) and the token rule.
STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "any", "can", "had", "her", "was", "one",
    "our", "out", "has", "have", "his", "how", "its", "may", "new", "now", "see", "two", "who", "did",
    "this", "that", "with", "from", "they", "will", "would", "there", "their", "what", "about", "which",
    "when", "were", "been", "into", "than", "then", "them", "these", "some", "such", "also", "more",
    "les", "des", "une", "est", "pas", "pour", "par", "sur", "dans", "avec", "que", "qui", "aux", "ces",
    "los", "las", "del", "por", "con", "una", "para", "como", "sus", "mas",
    "der", "die", "das", "und", "ein", "eine", "ist", "nicht", "mit", "von", "den", "dem", "auf", "für",
]
TOKEN_SPLIT = r"[^\p{L}]+"
MIN_TOKEN_CHARS = 3


def describable_products(products: DataFrame, subcats: DataFrame, cats: DataFrame, anchor: str) -> DataFrame:
    """Products of the anchor category that have a description.

    Written as LEFT joins like the reference; the category filter lets Catalyst
    turn them into inner joins.
    """
    sc = subcats.select("ProductSubcategoryKey", "EnglishProductSubcategoryName", "ProductCategoryKey")
    j = (products.join(sc, "ProductSubcategoryKey", "left")
                 .join(cats, "ProductCategoryKey", "left"))
    return j.filter((F.col("EnglishProductCategoryName") == anchor) & F.col("EnglishDescription").isNotNull())


def prompts(described: DataFrame, instruction: str = KEYWORD_INSTRUCTION, null_safe: bool = False) -> DataFrame:
    """Productkey, description, size, weight, prompt. NULL size/weight -> NULL prompt
    (SQL ``||`` semantics) unless ``null_safe``."""
    def part(c):
        v = F.col(c).cast("string")
        return F.coalesce(v, F.lit("")) if null_safe else v
    p = F.concat(F.lit(instruction), part("EnglishDescription"), F.lit(", Size: "), part("Size"),
                 F.lit(", Weight: "), part("Weight"), F.lit('"'))
    return described.select(F.col("ProductKey").alias("productkey"),
                            F.col("EnglishDescription").alias("description"),
                            F.col("Size").alias("size"), F.col("Weight").alias("weight"), p.alias("prompt"))


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term) for every token of the whole text: lowercase, split on non-letters,
    at least 3 letters, stop words removed."""
    words = F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("term")
    t = docs.select(F.col(id_col).alias("id"), words)
    return t.filter((F.length("term") >= MIN_TOKEN_CHARS) & ~F.col("term").isin(STOP_WORDS))


def keywords(docs: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """Top-k TF-IDF terms per document as ``refined_description`` ("a, b, c"); "" for a document without a usable token.

    tf = term count in the document, idf = ln((N + 1) / (df + 1)); ties by term.
    Term counts combine map-side and are written once, so texts are split into words once. The (doc, term) x (term, df)
    join is a shuffle join on the term; the document counts say which terms are hot, and those are dealt out.
    """
    tf = materialize(tokens(docs, id_col, text_col).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    df_ = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("__rows", F.col("df")))
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("N")))
    scored = join_split(tf, df_, "term", "__rows").crossJoin(n).withColumn(
        "score", F.col("tf") * F.log((F.col("N") + 1).cast("double") / (F.col("df") + 1).cast("double")))
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("term"))
    top = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    g = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("t"))
    listed = g.select("id", F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("refined_description"))
    ids = docs.select(F.col(id_col).alias("__doc"))
    return ids.join(listed, F.col("__doc").eqNullSafe(F.col("id")), "left").select(
        F.col("__doc").alias(id_col), F.coalesce("refined_description", F.lit("")).alias("refined_description"))


def _exactly_one(query: DataFrame) -> DataFrame:
    """The query as a local one-row frame, which bounds its broadcast and is read once; anything but one row is an error."""
    found = query.limit(2).collect()
    if len(found) != 1:
        raise ValueError("no query vector" if not found else "more than one query vector: use cosine_topk_many")
    return query.sparkSession.createDataFrame(found, query.schema)


def query_vector(corpus: DataFrame, id_col: str, vec_col: str, query_id) -> DataFrame:
    """One-row frame holding the vector of ``query_id``; an id that is missing or repeated is an error."""
    return _exactly_one(corpus.filter(F.col(id_col) == query_id).select(F.col(vec_col).alias("__q")))


def cosine_topk(corpus: DataFrame, id_col: str, vec_col: str, query: DataFrame, k: int = 10) -> DataFrame:
    """T4/T5: the k corpus rows most similar to a one-row query vector: (id, score).

    The one-row query is broadcast; scoring is a projection; ``orderBy().limit(k)``
    plans as a distributed top-k (TakeOrderedAndProject). Ties by id.
    """
    q = F.broadcast(_exactly_one(query.select(F.col(query.columns[0]).alias("__q"))))
    scored = corpus.select(id_col, vec_col).crossJoin(q) \
                   .select(F.col(id_col), cosine(vec_col, "__q").alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), F.asc(id_col)).limit(k)


def cosine_topk_many(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id_col: str,
                     query_vec_col: str, k: int = 3, approximate: bool = False) -> DataFrame:
    """Top-k neighbours for each query vector: (query_id, id, score, rank).

    Exact by default: blocked matrix products (``similarity.exact_topk``). ``approximate`` looks up a
    locality-sensitive index instead (``similarity.lsh_topk``).
    """
    search = similarity.lsh_topk if approximate else similarity.exact_topk
    return search(corpus, id_col, vec_col, queries, query_id_col, query_vec_col, k)


def similarity_search(hits: DataFrame, described: DataFrame) -> DataFrame:
    """T4: the hits (productkey, score) with the keywords of the product's description, best first.

    ``described`` is the keyword table (productkey, refined_description); a hit without keywords has null.
    """
    d = described.select(F.col("productkey").alias("__dk"), "refined_description")
    j = hits.join(d, F.col("productkey") == F.col("__dk"), "left")
    return j.select("productkey", "refined_description", "score").orderBy(F.desc_nulls_last("score"), "productkey")


def _known(hits: DataFrame) -> tuple[DataFrame, list]:
    """The hits as a local frame, and their keys. Hits are a top-k report: k rows, read once whatever joins them."""
    found = hits.select(F.col("productkey").alias("__hk"), "score").collect()
    return hits.sparkSession.createDataFrame(found, hits.select(F.col("productkey").alias("__hk"), "score").schema), sorted({r[0] for r in found if r[0] is not None})


def _enrich(hits: DataFrame, products: DataFrame, status: DataFrame, product_cols: list[str],
            status_cols: list[str]) -> DataFrame:
    """Hits with product and status columns. The k hits are fetched first; their keys become a filter that reaches the
    scans of both tables (row groups of a clustered table are skipped), and the left joins see k rows."""
    h, keys = _known(hits)
    of_hits = F.col("ProductKey").isin(keys)
    p = products.where(of_hits).select(F.col("ProductKey").alias("__pk"), *product_cols)
    s = status.where(of_hits).select(F.col("ProductKey").alias("__sk"), *status_cols)
    return (h.join(p, F.col("__hk") == F.col("__pk"), "left")
             .join(s, F.col("__hk") == F.col("__sk"), "left"))


def search_enriched(hits: DataFrame, products: DataFrame, status: DataFrame) -> DataFrame:
    """Hits LEFT JOIN product LEFT JOIN inventory status (the published table), best score first."""
    j = _enrich(hits, products, status, ["EnglishProductName", "Weight", "Size"], ["HasStock", "Margin_Pct"])
    return j.select(F.col("EnglishProductName").alias("Bike Name"), "Weight", "Size",
                    F.col("HasStock").alias("Has Stock"), F.col("Margin_Pct").alias("Margin"),
                    F.col("score").alias("Similarity")).orderBy(F.desc("Similarity"))


def search_described(hits: DataFrame, products: DataFrame, status: DataFrame) -> DataFrame:
    """Hits with name, description, stock flags and margin."""
    j = _enrich(hits, products, status, ["EnglishProductName", "EnglishDescription"],
                ["HasStock", "WeeksUntilStockAvailable", "Margin_Pct"])
    return j.select(F.col("__hk").alias("productkey"), "EnglishProductName", "EnglishDescription", "HasStock",
                    "WeeksUntilStockAvailable", "Margin_Pct")


# Fields of the recap payload.
RECAP_FIELDS = ["CustomerKey", "FirstName", "LastName", "TotalOrders", "TotalUnitsOrdered", "TotalSalesAmount",
                "POP_AvgTotalOrders", "POP_AvgTotalUnitsOrdered", "POP_AvgTotalSalesAmount", "LatestOrderDate",
                "EarliestOrderDate", "Gender", "HouseOwnerFlag", "NumberCarsOwned", "CommuteDistance",
                "YearlyIncome", "Lifetime_Spend", "future_spend_prediction_quartile",
                "future_purchase_prob_quartile", "bike_upsell_score_quartile", "upsell_list"]


def recap_json(details: DataFrame, instruction: str = RECAP_INSTRUCTION) -> DataFrame:
    """(CustomerKey, json_string, prompt) for every customer; NULL fields are omitted."""
    js = F.to_json(F.struct(*RECAP_FIELDS))
    return details.select("CustomerKey", js.alias("json_string"),
                          F.concat(F.lit(instruction), js).alias("prompt"))


# Fields of the return e-mail payload.
EMAIL_FIELDS = ["EmailAddress", "FirstName", "LastName", "SalesOrderNumber", "SalesOrderLineNumber",
                "EnglishProductName", "OrderQuantity", "UnitPrice"]


def email_rows(sales_view: DataFrame, offer: str = EMAIL_OFFER, coupon: str = EMAIL_COUPON,
               rep: str = EMAIL_REP, company: str = EMAIL_COMPANY) -> DataFrame:
    """DISTINCT order-line rows of the return e-mail with the offer constants."""
    return sales_view.select(*EMAIL_FIELDS, "CustomerKey").distinct().select(
        "CustomerKey", *EMAIL_FIELDS, F.lit(offer).alias("Offer"), F.lit(coupon).alias("CouponCode"),
        F.lit(rep).alias("SalesRepName"), F.lit(company).alias("CompanyName"))


def return_email_json(sales_view: DataFrame, returns: DataFrame, **consts) -> DataFrame:
    """One JSON payload per returned order line (returns: OrderNumber, LineNumber)."""
    r = returns.select(F.col("OrderNumber").alias("SalesOrderNumber"),
                       F.col("LineNumber").alias("SalesOrderLineNumber")).distinct()
    rows = email_rows(sales_view.join(r, ["SalesOrderNumber", "SalesOrderLineNumber"], "left_semi"), **consts)
    js = F.to_json(F.struct(*EMAIL_FIELDS, "Offer", "CouponCode", "SalesRepName", "CompanyName"))
    return rows.select("CustomerKey", "SalesOrderNumber", "SalesOrderLineNumber", js.alias("json_string"))


def order_json(line_json: DataFrame) -> DataFrame:
    """Per order, the line JSON strings in line order joined with a space.

    The result is one string per order, so an order's lines must meet in one task: its size is that of
    the output row, which an order (a basket a person has filled and which one e-mail lists) keeps small.
    """
    g = line_json.groupBy("CustomerKey", "SalesOrderNumber").agg(
        F.array_sort(F.collect_list(F.struct("SalesOrderLineNumber", "json_string"))).alias("l"))
    return g.select("CustomerKey", "SalesOrderNumber",
                    F.array_join(F.transform("l", lambda x: x["json_string"]), " ").alias("order_json"))
