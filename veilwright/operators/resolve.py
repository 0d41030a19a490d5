"""Keying, classification and quarantine: every source row gets one deterministic outcome.

Fact rows meet the ledger and the customer map on ``customer_key`` in one place, so both joins
share a single exchange. The build sides are unique per key; a customer with a large share of the
facts is split by AQE on the fact side only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.config import PipelineConfig
from veilwright.functions import keys as K
from veilwright.operators.maps import service_keys
from veilwright.operators.policy import apply_policy, attach_deletion_mode, governed_model
from veilwright.schemas import CONTRACTS
from veilwright.sources.tables import union_all

ACCEPTED = "ACCEPTED"

_EVENT_COLUMNS = [
    "event_id", "customer_key", "event_type", "occurred_at", "measure_value", "measure_unit",
    "source_updated_at",
]
_SERVICE_COLUMNS = [
    "service_id", "customer_key", "service_key", "service_version_key", "installation_address_key",
    "service_type", "is_valid", "valid_from", "valid_to", "source_updated_at",
]
_PAIR = ("customer_key", "service_key")
_packed, _unpacked = K.packed, K.unpacked
_INVOICE_COLUMNS = [
    "invoice_id", "customer_key", "service_key", "amount", "currency_code", "issued_date", "due_date",
    "is_paid", "paid_at", "source_is_due", "source_updated_at",
]


def with_customer_found(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Adds ``customer_found``: whether the row's key is in the customer map."""
    known = customers.select(F.col("customer_key").alias("_known_key"))
    joined = df.join(known, F.col("customer_key") == F.col("_known_key"), "left")
    return joined.select(*df.columns, F.col("_known_key").isNotNull().alias("customer_found"))


def accepted(resolution: DataFrame) -> DataFrame:
    return resolution.where(F.col("resolution_status") == ACCEPTED)


def rejected(resolution: DataFrame) -> DataFrame:
    return resolution.where(F.col("resolution_status") != ACCEPTED)


# ---- events -----------------------------------------------------------------------------------

def key_events(stg_events: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return stg_events.withColumn("customer_key", K.ssn_key(F.col("customer_ssn"), cfg.scheme)).select(
        _EVENT_COLUMNS
    )


def resolve_events(keyed: DataFrame, ledger: DataFrame, customers: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Deleted customers' events are always accepted; others need a mapped customer."""
    rows, deleted, known = (_packed(df, "customer_key") for df in (keyed, ledger, customers))
    annotated = attach_deletion_mode(rows, deleted, "customer_key", _EVENT_COLUMNS)
    status = F.when(F.col("deletion_mode").isNull() & ~F.col("customer_found"), "CUSTOMER_NOT_FOUND").otherwise(
        ACCEPTED
    )
    classified = with_customer_found(annotated, known).withColumn("resolution_status", status)
    return apply_policy(
        _unpacked(classified, "customer_key"),
        _EVENT_COLUMNS + ["resolution_status"],
        "REPLACE",
        {"customer_key": cfg.erased()},
        "is_erased_customer",
    )


def accepted_events(resolution: DataFrame) -> DataFrame:
    return accepted(resolution).select(CONTRACTS["int_customer_events_resolved"].names)


def quarantine_events(stg_events: DataFrame, resolution: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Readable source rows of rejected events, with the reason."""
    reasons = rejected(resolution).select("event_id", F.col("resolution_status").alias("quarantine_reason"))
    joined = stg_events.join(reasons, "event_id", "inner").withColumn("quarantined_at", cfg.run_timestamp())
    return joined.select(CONTRACTS["quarantine_customer_events"].names)


# ---- services ---------------------------------------------------------------------------------

def key_services(stg_services: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return stg_services.select(
        "service_id",
        *service_keys(cfg.scheme),
        "service_type",
        "is_valid",
        "valid_from",
        "valid_to",
        "source_updated_at",
    )


def resolve_services(
    keyed: DataFrame, ledger: DataFrame, customers: DataFrame, mapped: DataFrame
) -> DataFrame:
    """Deleted customers' services are dropped in both modes; the rest get the first failing reason."""
    tuple_keys = ["service_version_key", "customer_key", "service_key", "installation_address_key"]
    deleted, known = (_packed(df, "customer_key") for df in (ledger, customers))
    alive = governed_model(
        _packed(keyed, *tuple_keys), "int_customer_service_resolution", "SERVICE", "service_version_key", _SERVICE_COLUMNS, deleted
    )
    entries = _packed(mapped.select(*tuple_keys), *tuple_keys).withColumn("map_entry", F.lit(True))
    joined = _unpacked(with_customer_found(alive, known).join(entries, tuple_keys, "left"), *tuple_keys)
    status = (
        F.when(~F.col("customer_found"), "CUSTOMER_NOT_FOUND")
        .when(~F.col("is_valid"), "INVALID_VALIDITY_FLAG")
        .when(F.col("valid_to") < F.col("valid_from"), "INVALID_VALIDITY_PERIOD")
        .when(F.col("map_entry").isNull(), "PRIVA_MAP_ENTRY_NOT_FOUND")
        .otherwise(ACCEPTED)
    )
    return joined.select(*_SERVICE_COLUMNS, status.alias("resolution_status"))


def accepted_services(resolution: DataFrame) -> DataFrame:
    return accepted(resolution).select(CONTRACTS["int_customer_services_resolved"].names)


def quarantine_services(stg_services: DataFrame, resolution: DataFrame, cfg: PipelineConfig) -> DataFrame:
    reasons = rejected(resolution).select(
        "service_version_key", F.col("resolution_status").alias("quarantine_reason")
    )
    version = K.service_version_key(F.col("service_id"), F.col("valid_from"), cfg.scheme)
    joined = (
        stg_services.withColumn("service_version_key", version)
        .join(reasons, "service_version_key", "inner")
        .withColumn("quarantined_at", cfg.run_timestamp())
    )
    return joined.select(CONTRACTS["quarantine_customer_services"].names)


# ---- invoices ---------------------------------------------------------------------------------

def key_invoices(stg_invoices: DataFrame, cfg: PipelineConfig) -> DataFrame:
    return stg_invoices.select(
        "invoice_id",
        K.ssn_key(F.col("customer_ssn"), cfg.scheme).alias("customer_key"),
        K.service_id_key(F.col("service_id"), cfg.scheme).alias("service_key"),
        "amount",
        "currency_code",
        "issued_date",
        "due_date",
        "is_paid",
        "paid_at",
        F.col("is_due").alias("source_is_due"),
        "source_updated_at",
    )


def annotate_invoices(keyed: DataFrame, ledger: DataFrame) -> DataFrame:
    return attach_deletion_mode(keyed, ledger, "customer_key", _INVOICE_COLUMNS)


def annotate_services(keyed: DataFrame, ledger: DataFrame) -> DataFrame:
    columns = ["customer_key", "service_key", "service_version_key", "is_valid", "valid_from", "valid_to"]
    return attach_deletion_mode(keyed, ledger, "customer_key", columns)


def _source_periods(services: DataFrame, pair: list[str]) -> DataFrame:
    """Source rows, apart for living and deleted customers."""
    version = "service_version_key" if "service_version_key" in services.columns else "cast(null as string)"
    return services.selectExpr(
        *pair, "if(deletion_mode is null, 'alive', 'deleted') as kind", "valid_from", "valid_to", f"{version} as version",
        "coalesce(is_valid and valid_to >= valid_from, false) as usable",
    )


def _mapped_periods(resolved_services: DataFrame, pair: list[str]) -> DataFrame:
    """Accepted rows."""
    return resolved_services.selectExpr(
        *pair, "'mapped' as kind", "valid_from", "valid_to", "service_version_key as version",
        "coalesce(service_version_key is not null and valid_to >= valid_from, false) as usable",
    )


#: Changes of a pair's periods that travel in one row.
_BLOCK = 32
_LAST = "struct<valid_to: date, version: string>"
#: What a period adds on its first day, and takes back on the day after its last.
_ENDS = f"""inline(if(usable,
    array(
        named_struct('day', valid_from, 'step', 1, 'own', 1, 'ok', 1, 'last', named_struct('valid_to', valid_to, 'version', version)),
        named_struct('day', date_add(valid_to, 1), 'step', -1, 'own', 0, 'ok', 0, 'last', cast(null as {_LAST}))),
    array(named_struct('day', valid_from, 'step', 0, 'own', 1, 'ok', 0, 'last', cast(null as {_LAST})))))"""


def _sweep(invoices: DataFrame | None, periods: DataFrame, pair: list[str], changes: bool = False) -> DataFrame:
    """Of every pair and invoice day: the periods open on it, the last begun one, and the pair's rows.

    With ``changes`` also of the days on which a period begins or has ended, in both views. Days and the ends of periods are one
    relation, reduced to a row a pair and day before it is exchanged; running sums
    over a pair's days then count what is open. A pair has at most one row a calendar day.
    """
    merged = periods.where(" and ".join(f"{c} is not null" for c in pair)).selectExpr(*pair, "kind", _ENDS)
    if invoices is not None:
        days = invoices.selectExpr(
            *pair, "if(deletion_mode is null, 'plain', 'sees') as kind", "issued_date as day", "0 as step", "0 as own", "0 as ok",
            f"cast(null as {_LAST}) as last",
        )
        merged = merged.union(days)

    def of(kind: str, column: str, zero: str = "0") -> str:
        return f"if(kind = '{kind}', {column}, {zero})"

    sums = {f"open_{k}": of(k, "step") for k in ("alive", "deleted", "mapped")}
    totals = {f"{n}_{k}": of(k, c) for k in ("alive", "deleted") for n, c in (("rows", "own"), ("usable", "ok"))}
    lasts = {f"last_{k}": of(k, "last", "null") for k in ("alive", "deleted", "mapped")}
    aggregates = [f"sum({e}) as {n}" for n, e in (sums | totals).items()] + [f"max({e}) as {n}" for n, e in lasts.items()]
    views = [f"{'true' if changes else f'bool_or({test})'} as {n}" for n, test in (("plain", "kind = 'plain'"), ("sees", "kind = 'sees'"))]
    merged = merged.groupBy(*pair, "day").agg(*map(F.expr, (*aggregates, *views)))
    whole = f"partition by {', '.join(pair)}"
    running = f"({whole} order by day rows between unbounded preceding and current row)"
    swept = merged.selectExpr(
        *pair, "day", "plain", "sees",
        *(f"sum({c}) over {running} as {c}" for c in sums),
        *(f"sum({c}) over ({whole}) as {c}" for c in totals),
        *(f"last_value({c}, true) over {running} as {c}" for c in lasts),
    )
    views = "explode(array_compact(array(if(plain, false, null), if(sees, true, null)))) as sees_deleted"
    return swept.where("plain or sees").selectExpr("*", views)


def _day_stats(swept: DataFrame, pair: list[str]) -> DataFrame:
    """What an invoice of a pair, day and visibility sees; versions are null where they are not known yet: `unclear`.

    Where a pair has no rows of deleted customers, both views are alike.

    A single open period is the last begun one, as long as that has not ended; else it takes a look at the periods.
    """
    deleted = "if(sees_deleted, open_deleted, 0)"
    source = f"if(open_alive + {deleted} = 1, if(open_alive = 1, last_alive, last_deleted), null)"
    mapped = "if(open_mapped = 1, last_mapped, null)"
    seen = swept.selectExpr(
        *pair, "day as issued_date", "sees_deleted",
        "rows_alive + if(sees_deleted, rows_deleted, 0) as own_rows",
        "usable_alive + if(sees_deleted, usable_deleted, 0) as ok_rows", "rows_deleted = 0 as alike",
        f"open_alive + {deleted} as open_periods", "open_mapped as mapped_periods",
        f"if({source}.valid_to >= day, {source}.version, null) as source_version",
        f"if({mapped}.valid_to >= day, {mapped}.version, null) as mapped_version",
        f"open_alive + {deleted} > 0 and not coalesce({source}.valid_to >= day, false) as source_unclear",
        f"open_mapped > 0 and not coalesce({mapped}.valid_to >= day, false) as mapped_unclear",
    )
    return seen.selectExpr("* except (source_unclear, mapped_unclear)", "source_unclear or mapped_unclear as unclear")


def _kept(days: DataFrame) -> list[str]:
    return [c for c in days.columns if c not in ("source_version", "mapped_version")]


def _pieces(days: DataFrame, periods: DataFrame, pair: list[str]) -> DataFrame:
    """Periods cut at month ends, within the days their pair has, equal pieces as one with the greatest version.

    A month has a bounded number of different pieces, so a pair's rows grow with the calendar and not with its periods.
    """
    # The first and the last day with all their columns: then the sweep below is one exchange for this and for the days.
    row = f"struct(issued_date, {', '.join(c for c in _kept(days) if c != 'issued_date')})"
    span = days.groupBy(*pair).agg(F.expr(f"min({row}).issued_date as _first"), F.expr(f"max({row}).issued_date as _last"))
    # Null-safe, or filters on null keys would make another sweep of this one; no day of a null key is unclear.
    own = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in pair]
    spans = span.withColumnsRenamed({c: f"_of_{c}" for c in pair})
    clipped = periods.where("usable").join(spans, own).selectExpr("*", "greatest(valid_from, _first) as low", "least(valid_to, _last) as high")
    months = clipped.where("low <= high").selectExpr(
        *pair, "kind", "low", "high", "version", "explode(sequence(trunc(low, 'MM'), trunc(high, 'MM'), interval 1 month)) as month"
    )
    cut = months.selectExpr(
        *(f"{c} as _{c}" for c in (*pair, "month")), "kind", "greatest(low, month) as low", "least(high, last_day(month)) as high", "version"
    )
    return cut.groupBy(*(f"_{c}" for c in (*pair, "month")), "kind", "low", "high").agg(F.max("version").alias("version"))


def _versions(days: DataFrame, periods: DataFrame, pair: list[str]) -> DataFrame:
    """days, the unclear ones, with the greatest version open on each: a day meets the pieces of its own month only."""
    kept, pieces = _kept(days), _pieces(days, periods, pair)
    same = " and ".join(f"{c} <=> _{c}" for c in (*pair, "month"))
    found = days.selectExpr(*kept, "trunc(issued_date, 'MM') as month").join(
        pieces, F.expr(f"{same} and issued_date between low and high"), "left"
    )
    source = "kind = 'alive' or (kind = 'deleted' and sees_deleted)"
    return (
        found.groupBy(*kept)
        .agg(F.expr(f"max(if({source}, version, null)) as source_version"), F.expr("max(if(kind = 'mapped', version, null)) as mapped_version"))
        .select(days.columns)
    )


def _blocks(days: DataFrame, pair: list[str]) -> DataFrame:
    """Numbers a pair's days: its rows of one block travel together, and a block ends where the next begins."""
    over = f"(partition by {', '.join(pair)}, sees_deleted order by issued_date)"
    placed = days.selectExpr("*", f"row_number() over {over} - 1 as place", f"lead(issued_date) over {over} as next_day")
    ends = f"if(place % {_BLOCK} = {_BLOCK - 1}, next_day, null) as until"
    return placed.selectExpr(*days.columns, f"place div {_BLOCK} as block", ends)


def _lookups(asked: DataFrame | None, periods: DataFrame, pair: list[str], versions: bool) -> DataFrame:
    """What invoices of a pair see, whatever their day: between two changes of its periods nothing differs.

    A row has up to _BLOCK changes, in order; the first row of a pair (``low`` is null) also serves the days before them and no day. Pairs
    asked for that have no periods have one row without changes. Rows with ``alike`` are for both views.
    """
    swept = _sweep(asked, periods, pair, changes=True).where("not sees_deleted or rows_deleted > 0")
    days = _blocks(_day_stats(swept, pair), pair)
    if versions:
        days = days.where("not unclear").unionByName(_versions(days.where("unclear"), periods, pair))
    change = """if(issued_date is null, null, named_struct('day', issued_date, 'open', open_periods, 'mapped', mapped_periods,
        'source_version', source_version, 'mapped_version', mapped_version))"""
    rows = (
        _packed(days, "source_version", "mapped_version")
        .groupBy(*pair, "sees_deleted", "alike", "own_rows", "ok_rows", "block")
        .agg(F.min("issued_date").alias("low"), F.max("until").alias("high"), F.expr(f"array_sort(collect_list({change}))").alias("changes"))
    )
    return rows.selectExpr("* except (block, low)", "if(block = 0, null, low) as low")


def _with_service_rows(lookups: DataFrame, services: DataFrame, service: str) -> DataFrame:
    """Adds how many rows the service has at all, and of living customers."""
    # Grouped by a struct, so that the join exchanges the counts itself: AQE splits a hot service
    # only where both inputs come straight from an exchange on the join key.
    counts = (
        services.groupBy(F.struct(service).alias("grouped"))
        .agg(F.count("*").alias("all_rows"), F.count_if(F.col("deletion_mode").isNull()).alias("alive_rows"))
        .select(f"grouped.{service}", "all_rows", "alive_rows")
    )
    return lookups.join(counts, service, "left").select(*lookups.columns, "all_rows", "alive_rows")


def _attach(invoices: DataFrame, lookups: DataFrame, pair: list[str]) -> DataFrame:
    """Invoices with the lookup row of their pair, view and day, and with the last change up to that day as ``at``."""
    right = lookups.select([F.col(c).alias(f"_{c}") if c in pair else F.col(c) for c in lookups.columns])
    same = F.expr(
        """(alike or sees_deleted = (deletion_mode is not null))
        and coalesce(issued_date >= low, low is null) and coalesce(issued_date < high, high is null or low is null)"""
    )
    for c in pair:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = invoices.join(right, same, "left")
    return joined.withColumn("at", F.expr("try_element_at(filter(changes, x -> x.day <= issued_date), -1)"))


def with_service_stats(
    invoices: DataFrame,
    services: DataFrame | None = None,
    resolved_services: DataFrame | None = None,
    pair: list[str] | None = None,
    customers: DataFrame | None = None,
) -> DataFrame:
    """Adds source-service and mapped-service statistics to mode-annotated invoices; with ``customers`` also ``customer_found``.

    Ordinary invoices do not see deleted customers' services, erased ones do. Nothing is grouped by
    invoice and no invoice row is multiplied. What a pair's invoices see changes only where one of its periods begins or has ended: these
    days are swept, a pair at a time (_sweep); only days on which several periods are open look at the periods themselves (_versions).
    Service rows and customers are looked up for a pair, not for its invoices. The
    invoices are exchanged once, on service and customer: AQE splits a hot pair on the invoice side.
    """
    customer, service = pair or ["customer_key", "service_key"]
    keys = [service, customer]
    periods = []
    if services is not None:
        periods.append(_source_periods(services, keys))
    if resolved_services is not None:
        periods.append(_mapped_periods(resolved_services, keys))
    periods = union_all(periods)
    asked = None
    if services is not None or customers is not None:
        asked = invoices.selectExpr(*keys, "cast(null as date) as issued_date", "cast(null as string) as deletion_mode")
    lookups = _lookups(asked, periods, keys, services is None or "service_version_key" in services.columns)
    if services is not None:
        lookups = _with_service_rows(lookups, services, service)
        seen = f"if({customer} is null, null, if(deletion_mode is null, alive_rows, all_rows))"
    else:
        seen = "cast(null as bigint)"
    found = []
    if customers is not None:
        lookups = with_customer_found(lookups, customers)
        found = ["customer_found"]
    joined = _attach(invoices, lookups, keys).select(
        *invoices.columns, *found, F.expr(seen).alias("any_rows"), "own_rows", "ok_rows", "at.open", "at.mapped",
        "at.source_version", "at.mapped_version",
    )
    zero = F.lit(0).cast("bigint")
    return _unpacked(joined, "source_version", "mapped_version").select(
        *invoices.columns,
        *found,
        F.coalesce("any_rows", zero).alias("service_period_count"),
        F.coalesce("own_rows", zero).alias("customer_service_period_count"),
        F.coalesce("ok_rows", zero).alias("valid_service_period_count"),
        F.coalesce("open", zero).alias("effective_service_period_count"),
        F.col("source_version").alias("source_service_version_key"),
        F.coalesce("mapped", zero).alias("mapped_service_period_count"),
        F.col("mapped_version").alias("mapped_service_version_key"),
    )


def source_service_stats(invoices: DataFrame, services: DataFrame) -> DataFrame:
    packed = (_packed(df, *_PAIR) for df in (invoices, services))
    return with_service_stats(*packed).select(
        "invoice_id",
        "service_period_count",
        "customer_service_period_count",
        "valid_service_period_count",
        "effective_service_period_count",
        "source_service_version_key",
    )


def mapped_service_stats(invoices: DataFrame, resolved_services: DataFrame) -> DataFrame:
    packed, accepted_periods = (_packed(df, *_PAIR) for df in (invoices, resolved_services))
    return with_service_stats(packed, resolved_services=accepted_periods).select(
        "invoice_id",
        "mapped_service_period_count",
        F.col("mapped_service_version_key").alias("resolved_service_version_key"),
    )


def _service_reason(ordinary: Column) -> Column:
    return (
        F.when(ordinary & ~F.col("customer_found"), "CUSTOMER_NOT_FOUND")
        .when(F.col("service_period_count") == 0, "SERVICE_NOT_FOUND")
        .when(F.col("customer_service_period_count") == 0, "CUSTOMER_SERVICE_MISMATCH")
        .when(F.col("valid_service_period_count") == 0, "SERVICE_INVALID")
        .when(F.col("effective_service_period_count") == 0, "SERVICE_NOT_VALID_ON_ISSUE_DATE")
        .when(F.col("effective_service_period_count") > 1, "SERVICE_VERSION_AMBIGUOUS")
    )


def _with_payment_reason(reason: Column) -> Column:
    """Payment rules come last; a null flag or date falls through, as in SQL."""
    paid, paid_at = F.col("is_paid"), F.col("paid_at")
    return (
        reason.when(F.col("due_date") < F.col("issued_date"), "INVALID_INVOICE_DATE_RANGE")
        .when(paid & paid_at.isNull(), "PAYMENT_DATE_MISSING")
        .when(~paid & paid_at.isNotNull(), "PAYMENT_DATE_UNEXPECTED")
        .when(paid_at < F.col("issued_date"), "PAYMENT_BEFORE_ISSUE_DATE")
        .otherwise(ACCEPTED)
    )


def classify_invoices(
    invoices: DataFrame, services: DataFrame, resolved_services: DataFrame, customers: DataFrame
) -> DataFrame:
    """Twelve ordered checks, eleven reasons, else ACCEPTED; still carries the deletion mode."""
    pairs = (_packed(df, *_PAIR) for df in (invoices, services, resolved_services))
    return _unpacked(_classified(*pairs, _packed(customers, "customer_key")), *_PAIR)


def _classified(
    invoices: DataFrame, services: DataFrame, resolved_services: DataFrame, customers: DataFrame
) -> DataFrame:
    stats = with_service_stats(invoices, services, resolved_services, customers=customers)
    ordinary = F.col("deletion_mode").isNull()
    reason = (
        _service_reason(ordinary)
        .when(ordinary & (F.col("mapped_service_period_count") == 0), "SERVICE_MAP_ENTRY_NOT_FOUND")
        .when(ordinary & (F.col("mapped_service_period_count") > 1), "SERVICE_VERSION_AMBIGUOUS")
    )
    version = F.when(ordinary, F.col("mapped_service_version_key")).otherwise(
        F.col("source_service_version_key")
    )
    return stats.select(
        "invoice_id",
        "customer_key",
        "service_key",
        version.alias("resolved_service_version_key"),
        *[c for c in _INVOICE_COLUMNS if c not in ("invoice_id", "customer_key", "service_key")],
        "deletion_mode",
        _with_payment_reason(reason).alias("resolution_status"),
    )


def resolve_invoices(
    keyed_invoices: DataFrame,
    keyed_services: DataFrame,
    resolved_services: DataFrame,
    ledger: DataFrame,
    customers: DataFrame,
    cfg: PipelineConfig,
) -> DataFrame:
    """Classified invoices under the FACT policy: SPECIAL rows lose three keys, FULL rows are gone."""
    deleted = _packed(ledger, "customer_key")
    classified = _classified(
        annotate_invoices(_packed(keyed_invoices, *_PAIR), deleted),
        annotate_services(_packed(keyed_services, *_PAIR), deleted),
        _packed(resolved_services, *_PAIR),
        _packed(customers, "customer_key"),
    )
    return governed_model(
        _unpacked(classified, *_PAIR),
        "int_invoice_resolution",
        "FACT",
        "invoice_id",
        [
            "invoice_id", "customer_key", "service_key", "resolved_service_version_key", "amount",
            "currency_code", "issued_date", "due_date", "is_paid", "paid_at", "source_is_due",
            "source_updated_at", "resolution_status",
        ],
        special_columns=["customer_key", "service_key", "resolved_service_version_key"],
        mode_annotated=True,
        erased_key=cfg.erased_member_key,
    )


def with_due_flag(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """``is_due`` recomputed for the as-of date, beside the source's own flag."""
    due = ~F.col("is_paid") & (F.col("due_date") <= F.lit(cfg.as_of_date).cast("date"))
    return df.withColumn("is_due", due)


def accepted_invoices(resolution: DataFrame, cfg: PipelineConfig) -> DataFrame:
    rows = accepted(resolution).withColumnRenamed("resolved_service_version_key", "service_version_key")
    return with_due_flag(rows, cfg).select(CONTRACTS["int_invoices_resolved"].names)


def quarantine_invoices(stg_invoices: DataFrame, resolution: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Rejected and not erased; erased rejects appear nowhere.

    The resolution carries every source column but the two raw identifiers, so staged invoices are read and exchanged for these alone.
    """
    raw = stg_invoices.select("invoice_id", "customer_ssn", "service_id")
    joined = (
        rejected(resolution)
        .where(~F.col("is_erased_customer"))
        .withColumnRenamed("resolution_status", "quarantine_reason")
        .drop("customer_key", "service_key", "is_erased_customer")
        .join(raw, "invoice_id", "inner")
        .withColumn("quarantined_at", cfg.run_timestamp())
    )
    return joined.select(CONTRACTS["quarantine_invoices"].names)


def suppressed_invoices(resolution: DataFrame) -> DataFrame:
    """The third outcome: invalid invoices of SPECIAL customers, in neither output."""
    return rejected(resolution).where("is_erased_customer")


# ---- teaching variant on raw identifiers ------------------------------------------------------

def resolve_invoices_raw(
    stg_invoices: DataFrame,
    stg_services: DataFrame,
    deleted_ssns: DataFrame,
    current: DataFrame,
    cfg: PipelineConfig,
) -> DataFrame:
    """The ten-reason classifier on raw SSN and service id; it has no map lookups."""
    columns = [
        "invoice_id", "customer_ssn", "service_id", "amount", "currency_code", "issued_date",
        "due_date", "is_paid", "paid_at", "source_is_due", "source_updated_at",
    ]
    invoices = attach_deletion_mode(
        stg_invoices.withColumnRenamed("is_due", "source_is_due"),
        deleted_ssns,
        "customer_ssn",
        columns,
        ledger_key="customer_ssn",
    )
    services = attach_deletion_mode(
        stg_services,
        deleted_ssns,
        "customer_ssn",
        ["service_id", "customer_ssn", "is_valid", "valid_from", "valid_to"],
        ledger_key="customer_ssn",
    )
    known = current.select(F.col("customer_ssn").alias("_known_ssn"))
    found = invoices.join(known, F.col("customer_ssn") == F.col("_known_ssn"), "left").select(
        *invoices.columns, F.col("_known_ssn").isNotNull().alias("customer_found")
    )
    stats = with_service_stats(found, services, pair=["customer_ssn", "service_id"])
    status = _with_payment_reason(_service_reason(F.col("deletion_mode").isNull()))
    return apply_policy(
        stats.withColumn("resolution_status", status),
        [*columns, "resolution_status"],
        "REPLACE",
        {"customer_ssn": cfg.erased(), "service_id": cfg.erased()},
        "is_erased_customer",
    )


def quarantine_invoices_raw(stg_invoices: DataFrame, resolution: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Staged rows as they are, with the reason: this resolution has the raw identifiers too, so only its reason is taken."""
    reasons = (
        rejected(resolution)
        .where(~F.col("is_erased_customer"))
        .select("invoice_id", F.col("resolution_status").alias("quarantine_reason"))
    )
    joined = (
        stg_invoices.withColumnRenamed("is_due", "source_is_due")
        .join(reasons, "invoice_id", "inner")
        .withColumn("quarantined_at", cfg.run_timestamp())
    )
    return joined.select(CONTRACTS["quarantine_invoices"].names)
