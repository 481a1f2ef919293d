"""Canonical accounts-payable tables derived from the testdata parquet.

The derivations follow FIXTURES.md: every column is a deterministic
expression over ``orders``, ``lineitem``, ``part``, ``customer`` and
``nation``, so the same tables can be rebuilt in DuckDB for the oracles
(``oracles/fixtures.py``). All derivations are narrow projections except
``order_header`` (one small aggregate) and ``ledger_backup`` (one join), so
they add no shuffle to the jobs that read them, and they grow with the
testdata scale factor.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apflow.operators.joins import WrittenTables
from apflow.sources.testdata import read_table

# Fixed values of the fixture (FIXTURES.md), in natural order.
DUE_OFFSETS = [0, 30, 45, 60, 90, 120, -3]  # indexed by o_custkey % 7
PAYMENT_TERM_CODES = ["Due Upon Receipt", "Net 30", "Net 45", "Net 60", "Net 90", "Net 120", "Custom"]
PAYMENT_TERM_DAYS = [0, 30, 45, 60, 90, 120, None]
# account type id -> region of the fixture; id 20 is deliberately unmapped.
FIXTURE_REGIONS = {
    "AMER": range(0, 3),
    "EMEA": range(3, 12),
    "APAC": range(12, 18),
    "LATAM": range(18, 20),
}


def fixture_region_map() -> dict[str, str]:
    """Account-type name -> region for the fixture's 'Entity n' names."""
    return {f"Entity {i}": region for region, ids in FIXTURE_REGIONS.items() for i in ids}


def _plus_days(d: Column, n: Column) -> Column:
    return F.date_add(d, n.cast("int"))


def _pick(values: list, index: Column) -> Column:
    """``values[index]`` as a literal array lookup (index is 0-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _given_or_derived(fn):
    """A table property: the caller's own table when one was given, else the derivation."""
    name = fn.__name__

    def get(self):
        if name in self._given:
            return self._given[name]
        return fn(self)

    get.__doc__ = fn.__doc__
    return cached_property(get)


AP_TABLE_NAMES = (
    "invoice_header", "invoice_line", "order_line", "order_header", "exchange_rate", "currency", "payment_term",
    "account_type", "country", "supplier_dim", "supplier_information", "supplier_address", "ledger_backup",
    "ledger", "receivables", "survey", "vendor_payments",
)


class APTables:
    """The AP tables the jobs read, lazily built.

    By default every table is derived from one testdata folder (FIXTURES.md).
    In production pass your own warehouse tables, any subset, as
    ``tables={"invoice_header": spark.table("cat.db.invoice_header"), ...}``;

    Each property is a DataFrame plan, not data: nothing is read until an
    action runs, and a property reused by several jobs is just the same plan
    (Spark's exchange reuse shares identical subtrees within one query). The
    tables are taken as they are when a job first reads them: the small lookups
    that jobs write are shared by all later jobs over the same instance, until
    ``written.forget()``.
    """

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str | None = None,
        tables: dict[str, DataFrame] | None = None,
    ):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}
        #: lookups that the jobs over these tables have written and share
        self.written = WrittenTables()
        self._given = dict(tables or {})
        unknown = set(self._given) - set(AP_TABLE_NAMES) - {"aging"}
        if unknown:
            raise ValueError(f"unknown AP tables {sorted(unknown)}")

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str], sf_dir: str | None = None) -> "APTables":
        """AP tables read from catalog tables by 1-, 2- or 3-part name, e.g.
        ``{"invoice_header": "fin.ap.invoice_header", "ledger": "sandbox.wc.ledger"}``.
        """
        return cls(spark, sf_dir, tables={ap: spark.table(name) for ap, name in names.items()})

    def register_views(self, prefix: str = "") -> list[str]:
        """Register every AP table as a temporary view (``prefix + name``) for ``spark.sql``."""
        names = []
        for n in AP_TABLE_NAMES:
            getattr(self, n).createOrReplaceTempView(prefix + n)
            names.append(prefix + n)
        return names

    def raw(self, name: str) -> DataFrame:
        """The testdata table (one lazy scan per name; file listing happens once).
        """
        if name not in self._raw:
            if self.sf_dir is None:
                raise ValueError(f"no testdata folder to derive from ({name}); pass the AP table instead")
            self._raw[name] = read_table(self.spark, self.sf_dir, name)
        return self._raw[name]

    # ------------------------------------------------------------- invoices
    @_given_or_derived
    def invoice_header(self) -> DataFrame:
        o = self.raw("orders")
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        od = F.to_date("o_orderdate")
        price = F.col("o_totalprice").cast("decimal(18,2)")
        return o.select(
            k.alias("id"),
            F.when(k % 97 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("INV-"), c.cast("string"), F.lit("-"), F.date_format(od, "yyyyMM")))
            .alias("invoice_number"),
            od.alias("invoice_date"),
            _plus_days(od, _pick(DUE_OFFSETS, c % 7)).alias("net_due_date"),
            F.when(k % 53 == 0, F.lit(None).cast("date"))
            .otherwise(_plus_days(od, (k * 37) % 110 - 4))
            .alias("payment_date"),
            _plus_days(od, k % 5).alias("date_received"),
            _plus_days(od, k % 3).alias("created_at"),
            F.when(k % 61 == 0, -price).otherwise(price).cast("decimal(18,2)").alias("gross_total"),
            F.when(k % 17 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(price).alias("amount_due"),
            F.when(k % 59 == 0, F.lit(None).cast("bigint")).otherwise(k % 25).alias("currency_id"),
            F.when(k % 67 == 0, F.lit(None).cast("bigint")).otherwise(c).alias("supplier_id"),
            (c % 7).alias("payment_term_id"),
            (c % 22).alias("account_type_id"),
            F.when(k % 43 == 0, F.lit(None).cast("string"))
            .when(c % 11 == 0, F.lit("cxml"))
            .when(k % 9 == 0, F.lit("api"))
            .otherwise(F.lit("email"))
            .alias("channel"),
            F.when(k % 47 == 0, F.lit(None).cast("string"))
            .when(k % 31 == 0, F.lit("Voided"))
            .otherwise(F.lit("APPROVED"))
            .alias("status"),
            F.when(k % 19 == 0, F.lit("Credit Note")).otherwise(F.lit("Invoice")).alias("document_type"),
            (F.col("o_orderstatus") != "O").alias("paid"),
            F.col("o_orderpriority").alias("payment_channel"),
            (c % 40).alias("created_by_id"),
            (c % 33).alias("requested_by_id"),
        )

    @_given_or_derived
    def invoice_line(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.col("l_orderkey").alias("invoice_header_id"),
            F.col("l_linenumber").cast("bigint").alias("line_num"),
            F.col("l_partkey").alias("order_line_id"),
            ((F.col("l_orderkey") + F.col("l_linenumber")) % 25).alias("currency_id"),
            F.to_date("l_shipdate").alias("created_at"),
            F.col("l_returnflag").alias("status"),
            F.col("l_linestatus").alias("type"),
        )

    @_given_or_derived
    def order_line(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_size").cast("bigint").alias("order_header_id"),
        )

    @_given_or_derived
    def order_header(self) -> DataFrame:
        size = F.col("p_size").cast("bigint")
        return (
            self.raw("part")
            .select(size.alias("id"))
            .distinct()
            .select(
                "id",
                F.when(F.col("id") % 10 == 0, F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("PO-"), F.col("id").cast("string")))
                .alias("po_number"),
            )
        )

    # ---------------------------------------------------------------- rates
    @_given_or_derived
    def exchange_rate(self) -> DataFrame:
        k = F.col("o_orderkey")
        od = F.to_date("o_orderdate")
        return self.raw("orders").select(
            k.alias("id"),
            F.when(k % 10 == 9, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("from_currency_id"),
            ((k * 7) % 23).alias("to_currency_id"),
            (F.lit(0.5) + F.col("o_totalprice") / F.lit(100000.0)).alias("rate"),
            od.alias("created_at"),
            _plus_days(od, k % 9).alias("rate_date"),
        )

    # ----------------------------------------------------------- dimensions
    @_given_or_derived
    def currency(self) -> DataFrame:
        n = self.raw("nation")
        nid = F.col("n_nationkey").cast("bigint")
        return n.select(
            nid.alias("id"),
            F.concat(F.lit("C"), nid.cast("string")).alias("code"),
            F.col("n_name").alias("name"),
        )

    @_given_or_derived
    def payment_term(self) -> DataFrame:
        nid = F.col("n_nationkey").cast("bigint")
        return (
            self.raw("nation")
            .where(F.col("n_nationkey") < 7)
            .select(
                nid.alias("id"),
                _pick(PAYMENT_TERM_CODES, nid).alias("code"),
                _pick(PAYMENT_TERM_DAYS, nid).cast("bigint").alias("days_for_net_payment"),
            )
        )

    @_given_or_derived
    def account_type(self) -> DataFrame:
        nid = F.col("n_nationkey").cast("bigint")
        return (
            self.raw("nation")
            .where(F.col("n_nationkey") < 21)
            .select(nid.alias("id"), F.concat(F.lit("Entity "), nid.cast("string")).alias("name"))
        )

    @_given_or_derived
    def country(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")
        )

    @_given_or_derived
    def supplier_dim(self) -> DataFrame:
        """Supplier master (registered as ``supplier_dim``: ``supplier`` is a testdata table)."""
        cid = F.col("c_custkey")
        nk = F.col("c_nationkey").cast("bigint")
        custom = F.when(cid % 5 == 0, F.lit("{}")).otherwise(
            F.concat(
                F.lit('{"supplier-tier":{"name":"Tier '),
                (cid % 3 + 1).cast("string"),
                F.lit('"},"other":{"code":'),
                (cid % 7).cast("string"),
                F.lit("}}"),
            )
        )
        return self.raw("customer").select(
            cid.alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("S"), cid.cast("string")).alias("number"),
            (cid % 7).alias("payment_term_id"),
            F.when(nk % 6 == 5, F.lit(None).cast("bigint")).otherwise(nk % 6).alias("shipping_term_id"),
            F.col("c_mktsegment").alias("po_method"),
            (F.col("c_acctbal") > 0).alias("send_invoices_to_approvals"),
            custom.alias("custom_fields"),
        )

    @_given_or_derived
    def supplier_information(self) -> DataFrame:
        cid = F.col("c_custkey")
        return (
            self.raw("customer")
            .where(cid % 10 != 3)
            .select(
                (cid + 1).alias("id"),
                cid.alias("supplier_id"),
                F.col("c_name").alias("name"),
                F.when(cid % 4 == 0, F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("T"), cid.cast("string")))
                .alias("federal_tax_num"),
                F.concat(F.lit("N"), (cid % 50).cast("string")).alias("supplier_number"),
                F.concat(
                    F.lit('{"supplier-category":{"lookup":{"name":"Cat '),
                    (cid % 4).cast("string"),
                    F.lit('"}}}'),
                ).alias("custom_fields"),
            )
        )

    @_given_or_derived
    def supplier_address(self) -> DataFrame:
        cust = self.raw("customer")
        cid = F.col("c_custkey")
        nk = F.col("c_nationkey").cast("bigint")
        first = cust.select(cid.alias("id"), nk.alias("country_id"))
        second = cust.where(cid % 8 == 0).select(cid.alias("id"), ((nk + 1) % 25).alias("country_id"))
        return first.unionByName(second)

    # ---------------------------------------------------------------- ledger
    @_given_or_derived
    def ledger_backup(self) -> DataFrame:
        """Finance ledger before repair: real duplicates (k = 1 copies) included."""
        h = self.invoice_header.where(
            F.col("supplier_id").isNotNull() & (F.col("supplier_id") % 13 != 0) & (F.col("id") % 7 != 0)
        )
        cust = self.raw("customer").select("c_custkey", "c_name")
        joined = h.join(cust, h.supplier_id == cust.c_custkey, "inner")
        # k = 0 for every row, plus a k = 1 copy when id % 29 = 0
        k = F.explode(
            F.when(F.col("id") % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        )
        return joined.select("*", k.alias("k")).select(
            F.col("invoice_number").alias("invoice__"),
            F.col("c_name").alias("supplier"),
            F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("supplier__"),
            "payment_date",
            F.col("created_by_id").alias("requester"),
            F.col("gross_total").alias("total_usd"),
            "invoice_date",
            F.date_add("invoice_date", F.col("k")).alias("created_date"),
            F.col("date_received").alias("invoice_received_date"),
            "net_due_date",
        )

    @_given_or_derived
    def ledger(self) -> DataFrame:
        """The repaired ledger: J23 applied to :attr:`ledger_backup`."""
        from apflow.operators.invoices import dedupe_ledger

        return dedupe_ledger(self.ledger_backup)

    def ledger_period(self, start: str, end: str) -> DataFrame:
        """One upload period of the ledger (the reference's monthly upload table)."""
        return self.ledger.where(F.col("payment_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    # ------------------------------------------------- README report inputs
    @_given_or_derived
    def receivables(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", F.lit("Paid"))
            .when(F.col("o_orderstatus") == "O", F.lit("Pending"))
            .when(F.col("o_orderstatus") == "P", F.lit("Overdue"))
        )
        return self.raw("orders").select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").alias("invoice_amount"),
            status.alias("payment_status"),
        )

    def aging(self, as_of: str) -> DataFrame:
        """Unpaid invoices with their days overdue on ``as_of``; the caller's own ``aging`` table, where given, as it is."""
        if "aging" in self._given:
            return self._given["aging"]
        h =self.invoice_header.where(~F.col("paid"))
        cust = self.raw("customer").select("c_custkey", "c_name")
        return h.join(cust, h.supplier_id == cust.c_custkey, "left").select(
            F.col("id").alias("invoice_id"),
            F.col("supplier_id").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.datediff(F.lit(as_of).cast("date"), F.col("net_due_date")).cast("bigint").alias("days_overdue"),
            F.col("amount_due").alias("outstanding_balance"),
        )

    @_given_or_derived
    def survey(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("survey_id"),
            F.to_date("o_orderdate").alias("survey_date"),
            F.col("o_custkey").alias("customer_id"),
            (F.lit(1) + F.col("o_orderkey") % 5).alias("csat_score"),
        )

    @_given_or_derived
    def vendor_payments(self) -> DataFrame:
        h = self.invoice_header
        cust = self.raw("customer").select("c_custkey", "c_name")
        return h.join(cust, h.supplier_id == cust.c_custkey, "left").select(
            F.col("id").alias("invoice_id"),
            "payment_date",
            "invoice_date",
            "net_due_date",
            F.col("c_name").alias("vendor_name"),
            F.col("gross_total").alias("paid_amount"),
        )
