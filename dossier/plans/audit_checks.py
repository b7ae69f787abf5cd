"""The whole audit over fact tables that are views of the given tables, each check against SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import audit as op
from ..sources.shared import bucketed
from .registry import ITEMS, PARTS, item_parts, query, sliced, table

#: Lines of a bucket. A task sorts all fact tables of its bucket, so it is less than a slice.
BUCKET_ROWS = 100_000

_ROLES = "CASE source % 7 WHEN 0 THEN 'plan' WHEN 1 THEN 'request' WHEN 2 THEN 'onmck' WHEN 3 THEN 'contract' WHEN 4 THEN 'ooz' WHEN 5 THEN 'explanatory_note' ELSE 'commercial_offer' END"
_SIDE = "CASE WHEN flag = 'A' THEN 'plan' WHEN flag = 'R' THEN 'contract' ELSE 'onmck' END"
_FIELDS = {
    "subject": "CASE WHEN seq % 3 = 0 THEN upper(name) ELSE concat(' ', substr(name, 1, 6)) END",
    "funding": "CASE WHEN item % 4 = 0 THEN '-' WHEN item % 2 = 0 THEN 'budget' ELSE 'own' END",
    "delivery_place": "CASE WHEN seq % 5 = 0 THEN ' ' ELSE brand END",
    "warranty": "CASE WHEN item % 3 = 0 THEN '12 months' ELSE '12  Months ' END",
    "required": "CASE WHEN size < 25 THEN 'yes' ELSE 'no' END",
}
#: The fact tables as SQL over ``i`` (lines with their part) and ``o`` (orders), read by Spark and DuckDB alike.
_FACTS = {
    "files": f"SELECT pk, {_ROLES} AS role FROM i UNION ALL SELECT pk, 'commercial_offer' FROM i WHERE flag = 'N'",
    "fields": "\n        UNION ALL ".join(f"SELECT pk, {_SIDE}{' AS role' * (n == 0)}, '{name}'{' AS field' * (n == 0)}, {sql}{' AS value' * (n == 0)} FROM i" for n, (name, sql) in enumerate(_FIELDS.items())),
    "amounts": f"SELECT pk, {_SIDE} AS role, CASE WHEN item % 5 <> 0 THEN CASE WHEN seq < 3 THEN 100 ELSE 100 + seq % 4 END END AS amount FROM i UNION ALL SELECT pk, 'plan', CASE WHEN pk % 3 = 0 THEN amount ELSE 100 END FROM o",
    "rows": "SELECT pk, seq, qty, CASE WHEN seq % 6 <> 0 THEN total END AS price, CASE WHEN seq % 3 = 0 THEN total ELSE qty * total END AS total FROM i",
    "prices": "SELECT pk, seq % 2 AS seq, source % 3 AS source, qty, CASE WHEN item % 9 <> 0 THEN total END AS price, CASE WHEN item % 2 = 0 THEN qty * total END AS total, CASE WHEN pk % 2 = 0 THEN total * qty END AS declared, CASE WHEN pk % 3 <> 0 THEN total END AS declared_min FROM i",
    "offers": "SELECT pk, seq AS offer, CASE WHEN item % 7 <> 0 THEN 'n' ELSE ' ' END AS number, day AS date, 's' AS supplier, total FROM i",
    "offer_rows": "SELECT pk, source % 2 AS offer, qty, total AS price, CASE WHEN seq = 4 THEN NULL WHEN seq = 5 THEN total ELSE qty * total END AS total, CASE WHEN pk % 3 = 0 THEN qty * total ELSE 5 END AS declared FROM i",
    "items": "SELECT pk, flag AS role, CASE WHEN seq <> 6 THEN size % 3 END AS key, CASE WHEN seq % 7 <> 0 THEN CASE WHEN pk % 2 = 0 THEN qty ELSE 5 END END AS qty, CASE WHEN pk % 3 = 0 THEN kind ELSE 'pcs' END AS unit FROM i",
    "codes": "SELECT pk, CASE WHEN item % 2 = 0 THEN 'okpd2' ELSE 'ktru' END AS kind, CASE WHEN role = 'O' OR seq = 1 THEN 'plan' ELSE 'onmck' END AS role, substr(code, 2, 1) AS code FROM i",
    "stages": f"SELECT pk, {_SIDE} AS role, seq % 3 AS stage_no, CASE WHEN item % 8 <> 0 THEN day END AS end_date, CASE WHEN item % 10 <> 0 THEN total END AS price FROM i",
    "attachments": "SELECT pk, CASE WHEN flag = 'A' OR seq = 2 THEN 'listed' ELSE 'file' END AS side, size % 2 AS kind FROM i",
    "securities": "SELECT pk, CASE WHEN seq = 1 THEN 'bid' WHEN seq % 2 = 0 THEN 'performance' ELSE 'warranty' END AS kind, CASE WHEN item % 11 <> 0 THEN total * 300 END AS amount, CASE WHEN seq = 1 THEN tax / 4 ELSE tax * 2 END AS percent, item % 13 = 0 AS exempt FROM i",
    "clauses": "SELECT pk, CASE WHEN flag = 'A' THEN 'customer' ELSE 'supplier' END AS party, CASE WHEN role = 'O' AND flag <> 'A' THEN 'value' ELSE 'non_value' END AS kind, CASE WHEN role = 'O' AND flag <> 'A' THEN CASE WHEN seq % 2 = 0 THEN 10 ELSE 5 END ELSE CASE WHEN item % 2 = 0 THEN 1000 ELSE 5000 END END AS stated FROM i",
    "sections": "SELECT pk, CASE seq WHEN 1 THEN 'Привлечь СМП и СОНКО' WHEN 2 THEN 'Привлечь субъектов малого предпринимательства, 25 процентов' WHEN 3 THEN 'Вправе осуществлять замену субподрядчика' WHEN 4 THEN 'Гражданско-правовая ответственность за непредставление' END AS text FROM i",
}
#: Facts of which a line has several, for Spark.
_UNFOLDED = {
    "files": f"SELECT pk, explode(CASE WHEN flag = 'N' THEN array({_ROLES}, 'commercial_offer') ELSE array({_ROLES}) END) AS role FROM i",
    "fields": f"SELECT pk, {_SIDE} AS role, inline(array({', '.join(f"named_struct('field', '{name}', 'value', {sql})" for name, sql in _FIELDS.items())})) FROM i",
}
_ORDERS = "SELECT o_orderkey AS pk, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS state FROM orders"
_PACKAGES = "SELECT pk, CASE WHEN pk % 4 = 0 THEN amount * 100 ELSE amount END AS amount, CASE WHEN pk % 7 <> 0 THEN date_add(day, 60) END AS end_date, CASE WHEN state <> 'P' THEN state = 'F' END AS extra_present FROM o"


def _v(known: str, good: str) -> str:
    return f"CASE WHEN NOT coalesce({known}, false) THEN 'manual_review' WHEN coalesce({good}, false) THEN 'passed' ELSE 'failed' END"


def _texts(name: str, section: str, field: str, good: str, unclear: str = "''") -> str:
    norm = "nullif(trim(regexp_replace(lower(value), '\\s+', ' ', 'g')), '')"
    return f"""SELECT p.pk, '{section}.{name}', {_v(f"a IS NOT NULL AND b IS NOT NULL AND a NOT IN ({unclear}) AND b NOT IN ({unclear})", good)}
FROM p LEFT JOIN (SELECT pk, min({norm}) FILTER (role = 'plan') AS a, min({norm}) FILTER (role = 'contract') AS b FROM fields WHERE field = '{field}' GROUP BY pk) USING (pk)"""


def _simple(check_id: str, source: str, status: str) -> str:
    """A check whose measures are the columns of a query by pk."""
    return f"SELECT p.pk, '{check_id}', {status} FROM p LEFT JOIN ({source}) m USING (pk)"


_CODES = "SELECT pk, count(*) FILTER (own > 0) AS n, count(*) FILTER (own > 0 AND rest = 0) AS missing, count(*) FILTER (own = 0) AS extra FROM (SELECT pk, code, count(*) FILTER (role = 'plan') AS own, count(*) FILTER (role <> 'plan') AS rest FROM codes WHERE kind = '{}' GROUP BY pk, code) GROUP BY pk"
_STAGE = "SELECT pk, stage_no, count(*) FILTER (role = 'plan') AS own, count(*) FILTER (role = 'contract') AS rest, max(end_date) FILTER (role = 'plan') AS a, max(end_date) FILTER (role = 'contract') AS b FROM stages GROUP BY pk, stage_no"
_TOTALS = "SELECT pk, {0} AS g, bool_or(coalesce(total, qty * price) IS NULL) AS gaps, sum(coalesce(total, qty * price)) AS own, max(declared) AS said FROM {1} GROUP BY pk, {0}"
_VALUES = "SELECT pk, count(*) FILTER (n > 1) AS n, count(*) FILTER (n > 1 AND known < n) AS u, count(*) FILTER (n > 1 AND low <> high) AS w FROM (SELECT pk, key, count(*) AS n, count({0}) AS known, min({0}) AS low, max({0}) AS high FROM items WHERE key IS NOT NULL GROUP BY pk, key) GROUP BY pk"
_DUE = "CASE WHEN amount <= 300000000 THEN {} WHEN amount <= 5000000000 THEN {} WHEN amount <= 10000000000 THEN {} WHEN amount <= 50000000000 THEN {} WHEN amount IS NOT NULL THEN {} END"
_SAME = "contains(a, b) OR contains(b, a)"


def _security(kind: str, wrong: str) -> str:
    return _simple(f"security.{kind}", f"SELECT pk, count(*) AS n, count(*) FILTER (exempt) AS e, count(*) FILTER (amount IS NULL OR percent IS NULL) AS u, count(*) FILTER ({wrong}) AS w FROM securities WHERE kind = '{kind}' GROUP BY pk", f"CASE WHEN coalesce(n, 0) = 0 THEN 'not_applicable' ELSE {_v('e = 0 AND u = 0', 'w = 0')} END")


def _penalty(party: str, kind: str, *due: str) -> str:
    need = _DUE.format(*due)
    return _simple(f"penalty.{party}.{kind}", f"SELECT pk, min(stated) AS low, max(stated) AS high FROM clauses WHERE party = '{party}' AND kind = '{kind}' GROUP BY pk", _v("amount IS NOT NULL AND low IS NOT NULL", f"low = {need} AND high = {need}"))


def _clause(name: str, holds: str) -> str:
    return _simple(f"clause.{name}", f"SELECT pk, count(t) AS n, coalesce(bool_or({holds}), false) AS h FROM (SELECT pk, lower(text) AS t FROM sections) GROUP BY pk", _v("n > 0", "h"))


_N = "coalesce(n, 0)"
_BANDS = {
    "bid": "percent < 0.5 OR percent > CASE WHEN amount <= 2000000000 THEN 1 ELSE 5 END",
    "performance": "percent > 30 OR percent < CASE WHEN amount <= 5000000000 THEN 0.5 ELSE 10 END",
    "warranty": "percent > 10 OR percent < 0",
}
_EVERY = [
    *[_simple(f"completeness.{r}", f"SELECT pk, count(*) AS n FROM files WHERE role = '{r}' GROUP BY pk", f"CASE WHEN {_N} > 0 THEN 'passed' ELSE 'failed' END") for r in ("plan", "request", "onmck", "ooz", "contract", "explanatory_note")],
    _simple("completeness.offers", "SELECT pk, count(*) AS n FROM files WHERE role = 'commercial_offer' GROUP BY pk", f"CASE WHEN {_N} >= 3 THEN 'passed' ELSE 'manual_review' END"),
    _simple("schedule.fields", "SELECT pk, count(*) AS n, count(*) FILTER (value IS NULL OR trim(value) = '') AS blank FROM fields WHERE role = 'plan' GROUP BY pk", _v("n > 0", "blank = 0")),
    _simple("attachments.files", "SELECT pk, count(*) FILTER (a > 0) AS n, count(*) FILTER (a > b) AS missing, count(*) FILTER (a < b) AS extra FROM (SELECT pk, kind, count(*) FILTER (side = 'listed') AS a, count(*) FILTER (side = 'file') AS b FROM attachments GROUP BY pk, kind) GROUP BY pk", "CASE WHEN coalesce(n, 0) = 0 THEN 'manual_review' WHEN missing > 0 THEN 'failed' WHEN extra > 0 THEN 'warning' ELSE 'passed' END"),
    _simple("amounts.equal", "SELECT pk, count(DISTINCT role) AS n, min(amount) AS low, max(amount) AS high FROM amounts WHERE amount IS NOT NULL GROUP BY pk", _v("n >= 2", "low = high")),
    _simple("amounts.plan", "SELECT pk, max(amount) AS a FROM amounts WHERE role = 'plan' GROUP BY pk", _v("a IS NOT NULL AND amount IS NOT NULL", "a = amount")),
    _simple("rows.arithmetic", "SELECT pk, bool_and(qty IS NOT NULL AND price IS NOT NULL AND total IS NOT NULL) AS k, bool_or(qty * price <> total) AS w FROM rows GROUP BY pk", _v("k", "NOT w")),
    _simple("rows.sum", "SELECT pk, bool_and(total IS NOT NULL) AS k, sum(total) AS s FROM rows GROUP BY pk", _v("k AND amount IS NOT NULL", "s = amount")),
    _simple("prices.offers", "SELECT pk, min(n) AS least FROM (SELECT pk, seq, count(price) AS n FROM prices GROUP BY pk, seq) GROUP BY pk", "CASE WHEN least >= 3 THEN 'passed' ELSE 'manual_review' END"),
    _simple("prices.minimum", "SELECT pk, bool_or(low IS NULL OR said IS NULL) AS u, bool_or(low <> said) AS w FROM (SELECT pk, seq, min(price) AS low, max(declared_min) AS said FROM prices GROUP BY pk, seq) GROUP BY pk", _v("NOT u", "NOT w")),
    _simple("prices.variation", "SELECT pk, bool_and(n >= 2 AND mean <> 0) AS k, bool_or(n >= 2 AND mean <> 0 AND dev / mean * 100 >= 33) AS w FROM (SELECT pk, seq, count(price) AS n, avg(price) AS mean, stddev_samp(price) AS dev FROM prices GROUP BY pk, seq) GROUP BY pk", _v("k", "NOT coalesce(w, false)")),
    _simple("prices.rows", "SELECT pk, bool_or(qty IS NULL OR price IS NULL OR total IS NULL) AS u, bool_or(qty * price <> total) AS w FROM prices GROUP BY pk", _v("NOT u", "NOT coalesce(w, false)")),
    _simple("prices.source_totals", f"SELECT pk, bool_or(gaps OR said IS NULL) AS u, bool_or(own <> said) AS w FROM ({_TOTALS.format('source', 'prices')}) GROUP BY pk", _v("NOT u", "NOT w")),
    _simple("prices.totals_variation", f"SELECT pk, count(own) AS n, bool_or(gaps) AS g, avg(own) AS mean, stddev_samp(own) AS dev FROM ({_TOTALS.format('source', 'prices')}) GROUP BY pk", _v("n >= 2 AND NOT g AND mean <> 0", "dev / mean * 100 < 33")),
    _simple("offers.requisites", "SELECT pk, bool_or(trim(coalesce(number, '')) = '' OR date IS NULL OR total IS NULL) AS w FROM offers GROUP BY pk", _v("w IS NOT NULL", "NOT w")),
    _simple("offers.rows", "SELECT pk, bool_and(total IS NOT NULL) AS k, bool_or(qty * price <> total) AS w FROM offer_rows GROUP BY pk", _v("k", "NOT w")),
    _simple("offers.totals", f"SELECT pk, bool_or(gaps OR said IS NULL) AS u, bool_or(own <> said) AS w FROM ({_TOTALS.format('offer', 'offer_rows')}) GROUP BY pk", _v("NOT u", "NOT w")),
    *[_simple(f"codes.{k}", _CODES.format(k), "CASE WHEN coalesce(n, 0) = 0 THEN 'manual_review' WHEN missing > 0 THEN 'failed' WHEN extra > 0 THEN 'warning' ELSE 'passed' END") for k in ("okpd2", "ktru")],
    *[_simple(f"items.{v}", _VALUES.format(v), _v("n > 0 AND u = 0", "w = 0")) for v in ("qty", "unit")],
    _simple("stages.present", f"SELECT pk, count(*) FILTER (own > 0) AS n, count(*) FILTER (own > 0 AND rest = 0) AS missing, count(*) FILTER (own = 0 AND rest > 0) AS extra FROM ({_STAGE}) GROUP BY pk", "CASE WHEN coalesce(n, 0) = 0 THEN 'not_applicable' WHEN missing > 0 THEN 'failed' WHEN extra > 0 THEN 'warning' ELSE 'passed' END"),
    _simple("stages.ends", f"SELECT pk, count(*) AS n, bool_or(a IS NULL OR b IS NULL) AS u, bool_or(a <> b) AS w FROM ({_STAGE}) WHERE own > 0 AND rest > 0 GROUP BY pk", f"CASE WHEN {_N} = 0 THEN 'not_applicable' ELSE {_v('NOT u', 'NOT w')} END"),
    _simple("stages.term", "SELECT pk, bool_or(end_date IS NULL) AS u, max(end_date) AS last FROM stages WHERE role = 'plan' GROUP BY pk", f"CASE WHEN u IS NULL THEN 'not_applicable' ELSE {_v('end_date IS NOT NULL AND NOT u', 'last <= end_date')} END"),
    _simple("stages.prices", "SELECT pk, bool_or(price IS NULL) AS u, sum(price) AS s FROM stages WHERE role = 'plan' GROUP BY pk", f"CASE WHEN u IS NULL THEN 'not_applicable' ELSE {_v('amount IS NOT NULL AND NOT u', 's = amount')} END"),
    _texts("funding", "texts", "funding", "a = b", "'-', 'нет', 'не указано', 'unknown'"),
    *[_texts(f, "texts", f, _SAME) for f in ("subject", "delivery_place", "delivery_term", "payment", "acceptance", "warranty")],
    *[_texts(f, "subcontract", f, "a = b") for f in ("required", "percent")], *[_texts(f, "regime", f, "a = b") for f in ("ban", "restriction", "advantage")],
    *[_security(k, w) for k, w in _BANDS.items()],
    f"SELECT pk, 'requirements.extra', {_v('amount IS NOT NULL AND extra_present IS NOT NULL', 'extra_present = (amount > 2000000000)')} FROM p",
    _penalty("supplier", "value", "10", "5", "1", "0.5", "0.4"), _penalty("supplier", "non_value", "1000", "5000", "10000", "100000", "100000"), _penalty("customer", "non_value", "1000", "5000", "10000", "100000", "100000"),
    _clause("duty_with_share", "(contains(t, 'смп') OR contains(t, 'сонко') OR contains(t, 'субъектов малого предпринимательства')) AND contains(t, 'привлеч') AND contains(t, '25 процент')"),
    *[_clause(n, "false") for n in ("declaration_in_5_days", "replacement_in_5_days", "acceptance_in_10_days", "payment_in_7_days")],
    _clause("liability", "contains(t, 'ответственность за непредставление')"), _clause("right_to_replace", "contains(t, 'осуществлять замену')"),
]
_DUCK_FACTS = ",\n".join(f"{name} AS ({sql})" for name, sql in _FACTS.items())


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(packages, fact tables) of the given tables."""
    n = table(spark, sf_dir, "lineitem").count()
    # fourteen fact tables are views of these lines, and all of them are grouped and joined by package
    buckets = max(1 + n // BUCKET_ROWS, sliced(spark, n) or 1)
    lines = bucketed(item_parts(spark, sf_dir, "name", "brand", "kind", "size", "code", slices=buckets), "audit-lines", "pk", buckets)
    o = bucketed(spark.sql(_ORDERS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")), "audit-orders", "pk", buckets)
    bind = lambda sql: spark.sql(sql.replace(" FROM i", " FROM {i}").replace(" FROM o", " FROM {o}"), **{k: v for k, v in {"i": lines, "o": o}.items() if f" FROM {k}" in sql})
    # a union's rows are dealt again by package; where it is of lines alone, each line is unfolded instead
    own = {name: bind(sql) for name, sql in (_FACTS | _UNFOLDED).items()}
    return bind(_PACKAGES), own | {"amounts": own["amounts"].repartition(buckets, "pk")}


@query(f"""WITH {ITEMS.replace("items AS", "lines AS")}, {PARTS}, i AS (SELECT * FROM lines JOIN parts USING (item)), o AS ({_ORDERS}), p AS ({_PACKAGES.replace("date_add(day, 60)", "day + 60")}),
{_DUCK_FACTS},
f(pk, check_id, status) AS ({" UNION ALL ".join(_EVERY)})
SELECT pk::VARCHAR AS pk, check_id, status, CASE status WHEN 'failed' THEN 'high' WHEN 'manual_review' THEN 'medium' WHEN 'warning' THEN 'medium' ELSE 'info' END AS severity FROM f""")
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of all packages, one scan for each fact table."""
    packages, tables = facts(spark, sf_dir)
    return op.audit(packages, tables, op.standard_checks(), columns=["pk", "check_id", "status", "severity"], apart=True)
