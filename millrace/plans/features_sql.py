"""SQL of the feature tables, shared by several oracles."""

from .tables import TX_SQL

R2 = "sign({0}) * floor(abs({0}) * 100.0 + 0.5) / 100.0"


def r2(x: str) -> str:
    return R2.format(f"({x})")


def rnd(x: str, digits: int) -> str:
    scale = f"{10 ** digits}.0"
    return f"sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale}"


def esum(x: str) -> str:
    return f"CAST(printf('%.11e', CAST(sum(CAST({x} AS DOUBLE)) AS DOUBLE)) AS DOUBLE)"


def eavg(x: str) -> str:
    return f"({esum(x)} / count({x}))"


AS_OF = "(SELECT max(o_orderdate) FROM orders)"

USER_FEATURES_SQL = f"""WITH {TX_SQL}, win AS (SELECT * FROM tx WHERE event_timestamp >= {AS_OF} - INTERVAL 30 DAY),
fav AS (SELECT user_id, channel FROM (SELECT user_id, channel, count(*) AS n FROM win GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, channel) = 1)
SELECT user_id, {r2(esum('total_amount'))} AS user_total_spend_30d, {r2(eavg('total_amount'))} AS user_avg_order_value,
  {r2('CAST(sum(quantity) AS DOUBLE) / count(quantity)')} AS user_avg_quantity, CAST(sum(quantity) AS BIGINT) AS user_total_quantity_30d,
  count(event_id) AS user_transaction_count_30d, count(DISTINCT product_id) AS user_unique_products_30d,
  datesub('day', max(event_timestamp), {AS_OF}) AS user_days_since_last_purchase, any_value(fav.channel) AS user_favorite_channel
FROM win JOIN fav USING (user_id) GROUP BY user_id"""

PRODUCT_FEATURES_SQL = f"""WITH {TX_SQL}, win AS (SELECT * FROM tx WHERE event_timestamp >= {AS_OF} - INTERVAL 30 DAY),
fav AS (SELECT product_id, region FROM (SELECT product_id, region, count(*) AS n FROM win GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY n DESC, region) = 1)
SELECT product_id, {r2('quantile_cont(price, 0.5)')} AS product_median_price_30d, {r2(eavg('price'))} AS product_avg_price_30d,
  min(price) AS product_min_price_30d, max(price) AS product_max_price_30d, CAST(sum(quantity) AS BIGINT) AS product_total_sales_30d,
  {r2(esum('total_amount'))} AS product_total_revenue_30d, count(DISTINCT user_id) AS product_unique_buyers_30d,
  {r2('CAST(sum(quantity) AS DOUBLE) / count(quantity)')} AS product_avg_quantity_per_order,
  count(*) AS product_transaction_count_30d, any_value(fav.region) AS product_top_region
FROM win JOIN fav USING (product_id) GROUP BY product_id"""
