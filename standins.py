"""Inputs of the library's operators, derived from whole driver tables.

A part stands for a project. Each two lines of an order that were shipped one after the other
are a comparison of their parts, and the two amounts give the weights; the pair id is the order
key with the line's place in the order. Pairs first shipped before ``SPLIT`` are training pairs,
the others are test pairs. Lines of high amount write the project in mixed case; a low amount drops the URL prefix of side b.
A part's lines give its repository counts and dates. Suppliers receive funding and own the
repositories named after the brands and names of the parts they ship.

Each table has a Spark builder here and, for the oracle, SQL text of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sharewise.operators.metadata import project_dimension
from sharewise.operators.pairs import mirror, strip_urls

AS_OF = "2002-01-01 12:00:00"
SPLIT = "1997-02-01 00:00:00"
# In cents; a part key takes the low bits of a packed line.
MIXED_ABOVE = 8_000_000
PREFIX_ABOVE = 2_000_000
PART_BITS = 32
#: Places that the pair id keeps for the lines of an order.
LINES = 1024
LOOKUP_URLS = ("https://github.com/brand#1/blue-rod", "https://github.com/brand#1/hot-gear")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    """Two decimals as a whole number; floor stays in primitive code where round does not."""
    return F.floor(F.col(column) * 100 + 0.5)


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass and one shuffle: an order's lines lie together, each beside the next one.

    Amount and part share one long (amount first), which keeps the sorted rows narrow.
    """
    line = F.shiftleft(_cents("l_extendedprice"), PART_BITS).bitwiseOR(F.col("l_partkey"))
    in_order = W.partitionBy("l_orderkey").orderBy("shipped", "this")
    lines = (
        read(spark, sf_dir, "lineitem")
        .select("l_orderkey", F.col("l_shipdate").alias("shipped"), line.alias("this"))
        .withColumns({"place": F.row_number().over(in_order), "next": F.lead("this").over(in_order)})
    )

    def part(packed):
        return packed.bitwiseAND(F.lit((1 << PART_BITS) - 1))

    this, following = F.col("this"), F.col("next")
    swap = part(this) > part(following)
    ends = lines.filter(part(this) != part(following)).select(
        (F.col("l_orderkey") * LINES + F.col("place")).alias("id"),
        "shipped",
        F.when(swap, following).otherwise(this).alias("a"),
        F.when(swap, this).otherwise(following).alias("b"),
    )
    ends = ends.select(
        "id",
        "shipped",
        *[part(F.col(side)).alias(f"part_{side}") for side in ("a", "b")],
        *[F.shiftright(side, PART_BITS).alias(f"cents_{side}") for side in ("a", "b")],
    )

    def project(side):
        owner = F.when(F.col(f"cents_{side}") > MIXED_ABOVE, "Org/Part-")
        return F.concat(owner.otherwise("org/part-"), F.col(f"part_{side}").cast("string"))

    prefix = F.when(F.col("cents_b") > PREFIX_ABOVE, "https://github.com/").otherwise("")
    total = F.col("cents_a") + F.col("cents_b")
    return ends.select(
        "id",
        F.concat(F.lit("https://github.com/"), project("a")).alias("project_a"),
        F.concat(prefix, project("b")).alias("project_b"),
        (F.col("cents_a") / total).alias("weight_a"),
        (F.col("cents_b") / total).alias("weight_b"),
        "shipped",
    )


def raw_train(spark, sf_dir):
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    return all_pairs(spark, sf_dir).filter(F.col("shipped") < cut).drop("shipped")


def raw_test(spark, sf_dir):
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    return all_pairs(spark, sf_dir).filter(F.col("shipped") >= cut).select(
        "id", "project_a", "project_b"
    )


def train(spark, sf_dir):
    return strip_urls(raw_train(spark, sf_dir))


def test(spark, sf_dir):
    return strip_urls(raw_test(spark, sf_dir))


def compared(spark, sf_dir):
    """All pairs, with project ids and weights."""
    return strip_urls(all_pairs(spark, sf_dir).drop("shipped"))


def mirrored(spark, sf_dir):
    return mirror(compared(spark, sf_dir))


def mirrored_train(spark, sf_dir):
    return mirror(train(spark, sf_dir))


def repo_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lines(condition):
        return F.count_if(condition)

    def iso(ts):
        return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))

    quantity, tax = F.col("l_quantity"), F.col("l_tax")
    counts = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("first"),
        F.max("l_shipdate").alias("last"),
        F.sum(quantity.cast("bigint")).alias("size"),
        F.count(F.lit(1)).alias("stargazers_count"),
        lines(F.col("l_linestatus") == "O").alias("watchers_count"),
        lines(F.col("l_returnflag") == "R").alias("forks_count"),
        lines((quantity > 48) & (tax > 0.055)).alias("open_issues_count"),
        lines(F.col("l_returnflag") == "N").alias("subscribers_count"),
    )
    size = F.col("p_size")
    parts = read(spark, sf_dir, "part")
    return parts.join(counts, F.col("p_partkey") == F.col("l_partkey")).select(
        F.concat(F.lit("Org/Part-"), F.col("p_partkey").cast("string")).alias("full_name"),
        (size == 1).alias("private"),
        F.col("p_name").alias("description"),
        iso(F.col("first")).alias("created_at"),
        iso(F.col("last")).alias("updated_at"),
        F.when(size <= 15, None).when(size <= 30, "").otherwise("http://x").alias("homepage"),
        "size",
        "stargazers_count",
        "watchers_count",
        F.lower("p_type").alias("language"),
        (size > 25).alias("has_projects"),
        (F.col("p_retailprice") > 1000).alias("has_pages"),
        F.startswith("p_name", F.lit("red")).alias("has_wiki"),
        F.endswith("p_name", F.lit("bolt")).alias("has_discussions"),
        "forks_count",
        (size == 50).alias("archived"),
        (size == 49).alias("disabled"),
        "open_issues_count",
        "subscribers_count",
    )


def dimension(spark, sf_dir):
    return project_dimension(repo_metadata(spark, sf_dir))


def oss_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts are exact decimals, so that rounding a sum cannot depend on its order."""
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * (
        1 - F.col("l_discount").cast("decimal(3,2)")
    )
    li, orders, customer, nation, supplier = (
        read(spark, sf_dir, t)
        for t in ("lineitem", "orders", "customer", "nation", "supplier")
    )
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("o_orderdate").alias("time"),
            F.col("n_name").alias("from_project_name"),
            F.col("o_orderpriority").alias("grant_pool_name"),
            F.col("s_name").alias("to_project_name"),
            F.col("l_suppkey").alias("to_project_id"),
            amount.alias("amount"),
        )
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned by the suppliers that ship a part."""
    li, part, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    owners = supplier.select(F.col("s_suppkey").alias("l_suppkey"))
    url = F.concat(
        F.lit("https://github.com/"), F.lower("p_brand"), F.lit("/"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
    )
    size = F.col("p_size").cast("bigint")
    return (
        li.join(owners, "l_suppkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.col("l_suppkey").alias("project_id"),
            url.alias("artifact_url"),
            size.alias("star_count"),
            (size > 40).alias("is_fork"),
        )
        .agg(
            F.count(F.lit(1)).alias("fork_count"),
            F.min("l_shipdate").alias("created_at"),
            F.max("l_shipdate").alias("updated_at"),
        )
    )


def feature_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    gain = F.sum(_cents("p_retailprice") * F.col("p_size")) / 100.0
    return part.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("feature")).agg(
        gain.alias("gain")
    )


def model_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("model_id")).agg(
        (F.sum(_cents("value")) / n / 100.0).alias("mse"), (n / 1000.0).alias("r2")
    )


def scored_pairs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """All pairs with two simple predictions: star share and size share of side a."""
    from sharewise.plans.features import pair_features

    df = pair_features(compared(spark, sf_dir), dimension(spark, sf_dir), AS_OF)

    def usable(share):
        value = F.nanvl(F.col(share), F.lit(None).cast("double"))
        return F.coalesce(value, F.lit(0.5))

    return df.select(
        "id", "project_a", "project_b", "weight_a", "weight_b",
        usable("stars_ratio").alias("prediction"),
        usable("size_ratio").alias("base_prediction"),
        *keep,
    )


# ---------------------------------------------------------------------------------------
# The same tables as DuckDB text, written on their own (windows where Spark aggregates).

_TABLES_SQL = {
    "all_pairs": f"""
        SELECT id, shipped,
               'https://github.com/' || CASE WHEN a.cents > {MIXED_ABOVE} THEN 'Org/Part-' ELSE 'org/part-' END
                 || CAST(a.part AS VARCHAR) AS project_a,
               CASE WHEN b.cents > {PREFIX_ABOVE} THEN 'https://github.com/' ELSE '' END
                 || CASE WHEN b.cents > {MIXED_ABOVE} THEN 'Org/Part-' ELSE 'org/part-' END
                 || CAST(b.part AS VARCHAR) AS project_b,
               CAST(a.cents AS DOUBLE) / CAST(a.cents + b.cents AS DOUBLE) AS weight_a,
               CAST(b.cents AS DOUBLE) / CAST(a.cents + b.cents AS DOUBLE) AS weight_b
        FROM (SELECT one.l_orderkey * {LINES} + one.place AS id, one.l_shipdate AS shipped,
                     CASE WHEN one.line.part < two.line.part THEN one.line ELSE two.line END AS a,
                     CASE WHEN one.line.part < two.line.part THEN two.line ELSE one.line END AS b
              FROM ranked one
              JOIN ranked two ON one.l_orderkey = two.l_orderkey AND one.place + 1 = two.place
              WHERE one.line.part <> two.line.part)""",
    "ranked": """
        SELECT l_orderkey, l_shipdate, {'cents': cents, 'part': l_partkey} AS line,
               row_number() OVER (PARTITION BY l_orderkey
                 ORDER BY l_shipdate, cents, l_partkey) AS place
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)""",
    "raw_train": f"""
        SELECT id, project_a, project_b, weight_a, weight_b FROM all_pairs
        WHERE shipped < TIMESTAMP '{SPLIT}'""",
    "raw_test": f"""
        SELECT id, project_a, project_b FROM all_pairs WHERE shipped >= TIMESTAMP '{SPLIT}'""",
    "train": """
        SELECT id, split(project_a, 'github.com/')[-1] AS project_a,
               split(project_b, 'github.com/')[-1] AS project_b, weight_a, weight_b
        FROM raw_train""",
    "test": """
        SELECT id, split(project_a, 'github.com/')[-1] AS project_a,
               split(project_b, 'github.com/')[-1] AS project_b
        FROM raw_test""",
    "compared": """
        SELECT id, split(project_a, 'github.com/')[-1] AS project_a,
               split(project_b, 'github.com/')[-1] AS project_b, weight_a, weight_b
        FROM all_pairs""",
    "mirrored": """
        SELECT id, project_a, project_b, weight_a, weight_b FROM compared
        UNION ALL
        SELECT id, project_b, project_a, weight_b, weight_a FROM compared""",
    "mirrored_train": """
        SELECT id, project_a, project_b, weight_a, weight_b FROM train
        UNION ALL
        SELECT id, project_b, project_a, weight_b, weight_a FROM train""",
    "repo_metadata": """
        SELECT 'Org/Part-' || CAST(p_partkey AS VARCHAR) AS full_name, p_size = 1 AS private,
               p_name AS description,
               replace(CAST(min(l_shipdate) AS VARCHAR), ' ', 'T') || 'Z' AS created_at,
               replace(CAST(max(l_shipdate) AS VARCHAR), ' ', 'T') || 'Z' AS updated_at,
               CASE WHEN p_size <= 15 THEN NULL WHEN p_size <= 30 THEN '' ELSE 'http://x' END
                 AS homepage,
               CAST(sum(l_quantity) AS BIGINT) AS size,
               count(*) AS stargazers_count,
               count(*) FILTER (l_linestatus = 'O') AS watchers_count,
               lower(p_type) AS language, p_size > 25 AS has_projects,
               p_retailprice > 1000 AS has_pages, p_name LIKE 'red%' AS has_wiki,
               p_name LIKE '%bolt' AS has_discussions,
               count(*) FILTER (l_returnflag = 'R') AS forks_count,
               p_size = 50 AS archived, p_size = 49 AS disabled,
               count(*) FILTER (l_quantity > 48 AND l_tax > 0.055) AS open_issues_count,
               count(*) FILTER (l_returnflag = 'N') AS subscribers_count
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY p_partkey, p_name, p_type, p_size, p_retailprice""",
    "dimension": """
        SELECT lower(full_name) AS project_id, private AS is_private, description, created_at,
               updated_at, homepage IS NOT NULL AS has_homepage, size,
               stargazers_count AS stars, watchers_count AS watchers, language, has_projects,
               has_pages, has_wiki, has_discussions, forks_count AS forks,
               archived AS is_archived, disabled AS is_disabled,
               open_issues_count AS open_issues, subscribers_count
        FROM repo_metadata""",
    "oss_funding": """
        SELECT o_orderdate AS time, n_name AS from_project_name,
               o_orderpriority AS grant_pool_name, s_name AS to_project_name,
               l_suppkey AS to_project_id,
               CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(3,2)))
                 AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN supplier ON l_suppkey = s_suppkey""",
    "repositories": """
        SELECT l_suppkey AS project_id,
               'https://github.com/' || lower(p_brand) || '/' || replace(p_name, ' ', '-')
                 AS artifact_url,
               CAST(p_size AS BIGINT) AS star_count, p_size > 40 AS is_fork,
               count(*) AS fork_count, min(l_shipdate) AS created_at,
               max(l_shipdate) AS updated_at
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
        GROUP BY ALL""",
    "feature_gain": """
        SELECT p_brand || ' ' || p_type AS feature,
               CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT) * p_size) AS DOUBLE) / 100.0
                 AS gain
        FROM part GROUP BY 1""",
    "model_points": """
        SELECT user_id AS model_id,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0
                 AS mse,
               count(*) / 1000.0 AS r2
        FROM events GROUP BY 1""",
}


def with_tables(text: str, *names: str) -> str:
    """Oracle text with the named stand-in tables (and what they need) put before it."""
    needs = {
        "all_pairs": ["ranked"], "raw_train": ["all_pairs"], "raw_test": ["all_pairs"],
        "train": ["raw_train"], "test": ["raw_test"], "compared": ["all_pairs"],
        "mirrored": ["compared"], "mirrored_train": ["train"],
        "dimension": ["repo_metadata"],
    }
    ordered: list[str] = []

    def add(name):
        for need in needs.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    tables = ",\n".join(f"{n} AS ({_TABLES_SQL[n]})" for n in ordered)
    return f"WITH {tables}{text}"
