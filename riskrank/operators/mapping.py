"""Cleaning of accounts and transactions and the account-to-customer mapping."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskrank.functions.keys import canonical_account, canonical_bank, trimmed
from riskrank.functions.maths import percent
from riskrank.operators.counting import distinct_counts
from riskrank.operators.joins import hot_digests, spread_left_join
from riskrank.session import materialise

TIME_FORMAT = "yyyy/MM/dd HH:mm"
ACCOUNT_KEY = ["bank_id", "account_number"]
ROLES = ["sender", "receiver"]
LOOKUP_ROWS = 1_000_000  # accounts that are sent whole to every executor
LOOKUP_BYTES = 64 << 20  # and the bytes of their texts
HASHED_ROWS = 500_000  # accounts per partition of which a task holds a hash table


def clean_accounts(raw: DataFrame) -> DataFrame:
    return raw.select(
        trimmed("Bank Name").alias("bank_name"),
        canonical_bank("Bank ID").alias("bank_id"),
        canonical_account("Account Number").alias("account_number"),
        trimmed("Entity ID").alias("entity_id"),
        trimmed("Entity Name").alias("entity_name"),
    )


# Raw name, kind and name after cleaning, in the published order.
TRANSACTION_COLUMNS = [
    ("Timestamp", "moment", "transaction_timestamp"),
    ("From Bank", "bank", "from_bank_id"),
    ("Account2", "account", "from_account"),
    ("To Bank", "bank", "to_bank_id"),
    ("Account4", "account", "to_account"),
    ("Amount Paid", "double", "amount_paid"),
    ("Amount Received", "double", "amount_received"),
    ("Payment Currency", "text", "payment_currency"),
    ("Receiving Currency", "text", "receiving_currency"),
    ("Payment Format", "text", "payment_format"),
    ("Is Laundering", "int", "is_laundering"),
    ("Timestamp", "day", "transaction_date"),
]


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Typed columns with canonical keys; values that do not parse become NULL."""
    def moment(name: str) -> Column:
        return F.try_to_timestamp(name, F.lit(TIME_FORMAT))

    kinds = {
        "moment": moment,
        "day": lambda name: F.to_date(moment(name)),
        "bank": canonical_bank,
        "account": canonical_account,
        "text": trimmed,
        "double": lambda name: F.col(name).try_cast("double"),
        "int": lambda name: F.col(name).try_cast("int"),
    }
    return raw.select(*[kinds[kind](name).alias(out) for name, kind, out in TRANSACTION_COLUMNS])


def ambiguous_keys(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that point at more than one distinct value.

    Rows are first counted per (key, value), so copies of one pair collapse
    before the per-key step.
    """
    pairs = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    return (
        pairs.groupBy(*keys)
        .agg(F.count(value).alias("entity_count"), F.sum("copies").alias("row_count"))
        .filter(F.col("entity_count") > 1)
    )


def assert_unique_mapping(df: DataFrame, keys: list[str], value: str) -> None:
    """Raise when any key is ambiguous; a few offenders go into the message."""
    offenders = ambiguous_keys(df, keys, value).limit(20).collect()
    if offenders:
        shown = ", ".join(str(tuple(row[k] for k in keys)) for row in offenders)
        raise ValueError(f"{keys} must determine {value}; conflicting keys include {shown}")


def deduplicate(df: DataFrame, keys: list[str], most_broadcast: int = 10_000) -> DataFrame:
    """One row per key: the smallest by the other columns, whatever the input order. NULL keys are keys.

    A minimum over strings sorts its whole input. So copies are hashed away first (their
    count is used, or Spark would undo that step), hashed counts tell which keys still
    have several rows, and only the rows of those keys are ordered. Up to
    ``most_broadcast`` such keys are broadcast.
    """
    rest = [c for c in df.columns if c not in keys]
    single = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")).filter(
        F.col("_copies") > 0).drop("_copies")
    clashing = materialise(single.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(
        F.col("_rows") > 1).select(*[F.col(k).alias(f"_clash_{i}") for i, k in enumerate(keys)]), "clashing-keys")
    found = clashing.limit(most_broadcast + 1).count()
    if not found:
        return single
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_clash_{i}")) for i, k in enumerate(keys)))
    other = F.broadcast(clashing) if found <= most_broadcast else clashing
    smallest = F.min(F.struct(*rest)).alias("kept")
    settled = single.join(other, same, "left_semi").groupBy(*keys).agg(smallest).select(
        *[F.col(c) if c in keys else F.col(f"kept.{c}") for c in df.columns])
    return single.join(other, same, "left_anti").unionByName(settled)


def customer_accounts(raw_accounts: DataFrame, check: bool = True) -> DataFrame:
    """Clean, verified and de-duplicated account table."""
    cleaned = clean_accounts(raw_accounts)
    if check:
        assert_unique_mapping(cleaned, ACCOUNT_KEY, "entity_id")
    return deduplicate(cleaned, ACCOUNT_KEY)


def _few(accounts: DataFrame) -> tuple[bool, int]:
    """Whether the accounts may be sent to every executor, and how many they are."""
    texts = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in accounts.columns), F.lit(0))
    row = accounts.agg(F.count(F.lit(1)).alias("rows"), F.sum(texts.cast("long")).alias("bytes")).first()
    return row["rows"] <= LOOKUP_ROWS and (row["bytes"] or 0) <= LOOKUP_BYTES, row["rows"]


def _owners(accounts: DataFrame, role: str) -> DataFrame:
    return accounts.select(
        F.col("bank_id").alias("owner_bank"),
        F.col("account_number").alias("owner_account"),
        F.col("entity_id").alias(f"{role}_entity_id"),
        F.col("entity_name").alias(f"{role}_entity_name"),
    )


def _same_account(cols: list[str]) -> Column:
    return reduce(and_, (F.col(c) == F.col(o) for c, o in zip(cols, ["owner_bank", "owner_account"])))


def small_lookups(transactions: DataFrame, accounts: DataFrame, keys: dict[str, list[str]],
                  few: bool) -> dict[str, DataFrame]:
    """The owners per role, for the roles whose accounts are ``_few``.

    If not all accounts are few, those that the transactions name in a role may
    be. A sketch of each role's keys tells where it is worth looking: a role of
    few keys is grouped by them, which hardly shuffles anything.
    """
    if few:
        return {role: _owners(accounts, role) for role in keys}
    guess = transactions.agg(*[F.approx_count_distinct(F.xxhash64(*cols)).alias(role) for role, cols in keys.items()])
    named, found = guess.first().asDict(), {}
    for role, cols in keys.items():
        if named[role] > LOOKUP_ROWS:
            continue
        used = transactions.select(*cols).distinct()
        owners = materialise(_owners(accounts, role).join(used, _same_account(cols), "left_semi"), "named-accounts")
        if _few(owners)[0]:
            found[role] = owners
    return found


def enrich_transactions(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Attach the owning entity of both accounts; unmatched transactions stay.

    Accounts that are few, in all or in one role, are sent to the transactions,
    which then stay where they are. For the other roles the transactions are
    shuffled; one pass over the bare ones finds the hot accounts of these roles.
    """
    sides = {"sender": "from", "receiver": "to"}
    keys = {role: [f"{side}_bank_id", f"{side}_account"] for role, side in sides.items()}
    few, size = _few(accounts.select(*ACCOUNT_KEY, "entity_id", "entity_name"))
    small = small_lookups(transactions, accounts, keys, few)
    large = {role: cols for role, cols in keys.items() if role not in small}
    hot = hot_digests(transactions, large) if large else {}
    hashed = size <= HASHED_ROWS * int(transactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enriched = transactions
    for role, cols in large.items():  # before the others, while the rows are narrow
        enriched = spread_left_join(
            enriched, _owners(accounts, role), list(zip(cols, ["owner_bank", "owner_account"])), hot[role], hashed)
    for role, owners in small.items():
        enriched = enriched.join(F.broadcast(owners), _same_account(keys[role]), "left").drop(
            "owner_bank", "owner_account")
    return enriched.select(
        *transactions.columns, *[f"{role}_entity_{part}" for role in sides for part in ("id", "name")])


def by_role(transactions: DataFrame, *kept: str) -> DataFrame:
    """Two rows per transaction, one per role, with the entity in that role and ``kept``.

    Grouping these by (role, entity) turns exact distinct entity counts into
    row counts, and combines on the map side.
    """
    roles = F.array(*[
        F.struct(F.lit(role).alias("role"), F.col(f"{role}_entity_id").alias("entity"))
        for role in ROLES
    ])
    return transactions.select(*kept, F.inline(roles))


def role_counts(count: str = "n") -> dict[str, Column]:
    """Aggregates over (role, entity) rows: all transactions and entities per role."""
    known = F.col("entity").isNotNull()
    rows = F.when(F.col("role") == ROLES[0], F.col(count)).otherwise(0)
    return {"transactions": F.coalesce(F.sum(rows), F.lit(0))} | {
        role: F.count_if(known & (F.col("role") == role)) for role in ROLES}


def mapping_summary(enriched: DataFrame) -> DataFrame:
    """Coverage of the mapping: volume, unmatched sides, entities, time range, match rates."""
    per_entity = by_role(enriched, "transaction_timestamp").groupBy("role", "entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("transaction_timestamp").alias("first_seen"),
        F.max("transaction_timestamp").alias("last_seen"),
    )
    counts = role_counts()
    unmatched = {
        f"unmatched_{role}s": F.coalesce(F.sum(F.when(
            F.col("entity").isNull() & (F.col("role") == role), F.col("n")).otherwise(0)), F.lit(0))
        for role in ROLES
    }
    summary = per_entity.agg(
        counts["transactions"].alias("transactions"),
        *[expr.alias(name) for name, expr in unmatched.items()],
        *[counts[role].alias(f"distinct_{role}_entities") for role in ROLES],
        F.min("first_seen").alias("minimum_timestamp"),
        F.max("last_seen").alias("maximum_timestamp"),
    )
    total = F.col("transactions")
    return summary.withColumns({
        f"{role}_match_percentage": percent(total - F.col(f"unmatched_{role}s"), total, 4)
        for role in ROLES
    })


def accounts_per_entity(accounts: DataFrame, top: int | None = 20) -> DataFrame:
    """Accounts and banks per entity, largest first; ``top=None`` keeps all."""
    sizes = (
        accounts.groupBy("entity_id", "entity_name", "bank_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity_id", "entity_name")
        .agg(F.sum("n").alias("account_count"), F.count("bank_id").alias("bank_count"))
        .orderBy(F.desc("account_count"), "entity_id", "entity_name")
    )
    return sizes if top is None else sizes.limit(top)


def entity_names(pairs: DataFrame, key: str = "entity_id", name: str = "entity_name") -> DataFrame:
    """One name per entity: the smallest one, hence independent of row order.

    Copies collapse in a hash aggregate first, because a minimum over strings
    has to sort its input. The always-true filter on the count keeps that first
    step: Spark drops a plain distinct below a minimum.
    """
    copies = pairs.groupBy(key, name).agg(F.count(F.lit(1)).alias("copies"))
    return copies.filter(F.col("copies") > 0).groupBy(key).agg(F.min(name).alias(name))


def entity_rollup(accounts: DataFrame) -> DataFrame:
    """Name, distinct account numbers and distinct banks of every entity."""
    counts = distinct_counts(accounts, "entity_id", {
        "account_count": F.col("account_number"),
        "bank_count": F.col("bank_id"),
    })
    return entity_names(accounts).join(counts, "entity_id")
