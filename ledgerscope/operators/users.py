"""User side: sign-up cohort with activity flags (J8, J8a, J8b), its KPIs
(J9), demographic clean-up (J10) and distributions (J11, J12).

Activity is the union of five sources in the window: budgets, external
transactions, investment-plan and savings-plan transactions, and chat
messages.  Ids are compared as text, as the source does (the message table
stores them as text).  The union is not de-duplicated per branch; one
``distinct`` over all of it is combined map-side before its shuffle, so a
user with a huge share of activity costs one row per task, not per event.
The sign-up cohort (J8) needs the activity of its own users only: each of the five
scans drops the others' before any shuffle (``CohortFilter``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import reference_data as rd
from ledgerscope.functions import text
from ledgerscope.functions.periods import Window
from ledgerscope.operators.ledger import PAIR, all_small, by_pair, facts, ledger
from ledgerscope.operators.membership import bits_for, bloom, kept, may_hold, read_once
from ledgerscope.sources.tables import LedgerTables


def active_users(t: LedgerTables, window: Window) -> DataFrame:
    """Distinct ``user_id`` (text) active in the window."""
    return t.staged(("active_users", window), lambda: _active_users(t, window))


Kept = Callable[[DataFrame, str], DataFrame]


def _active_users(t: LedgerTables, window: Window, keep: Kept = lambda rows, column: rows) -> DataFrame:
    """``keep(rows, column)`` drops rows whose user is of no interest, before any shuffle."""
    branches = [
        keep(t.budgets.filter(window.ts_between("created_at"))
             .select(F.col("user_id").cast("string").alias("user_id")), "user_id"),
        keep(t.external_transactions.filter(window.ts_between("created_at"))
             .select(F.col("user_id").cast("string").alias("user_id")), "user_id"),
        _plan_users(t, window, keep),
        keep(t.messages.filter(window.ts_between("created_at"))
             .select(F.col("user_ref").cast("string").alias("user_id")), "user_id"),
    ]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out.distinct()


def _plan_users(t: LedgerTables, window: Window, keep: Kept) -> DataFrame:
    """Users of the plans with a transaction in the window.

    Where the plans are large, the window's different pairs of plan ids are found before the joins,
    and of those only the pairs with a plan whose user is kept.
    """
    if all_small(t):
        tx = ledger(t, users=False, assets=False).filter(window.ts_between("transaction_date"))
        return keep(_matched_plan_users(tx), "user_id")
    rows = facts(t).filter(window.ts_between("transaction_date"))
    rows = keep.plans(rows) if hasattr(keep, "plans") else rows
    pairs = rows.select(*PAIR).distinct()
    return keep(_matched_plan_users(by_pair(t, pairs, users=False, assets=False)), "user_id")


class CohortFilter:
    """Keeps rows of the cohort's users, and may keep others: what follows compares ids again.

    A user base within the broadcast bounds is a broadcast semi join; a larger one a membership filter of bounded
    size (``membership``) over the cohort's ids, and for transactions, which name plans only, one over the
    ids of the cohort's plans of each kind.
    """

    def __init__(self, t: LedgerTables, ids: DataFrame):
        self.t, self.ids = t, ids
        self.bits = bits_for(t.rows("users"))
        self.words = None if t.is_small("users") else bloom(ids, "user_id", self.bits)

    def __call__(self, rows: DataFrame, column: str) -> DataFrame:
        if self.words is None:
            few = F.broadcast(self.ids.select(F.col("user_id").alias("_cohort")))
            return rows.join(few, F.col(column) == F.col("_cohort"), "left_semi")
        return kept(read_once(rows, column), self.words, F.col(f"_tested.{column}"), self.bits).drop("_tested")

    def plans(self, rows: DataFrame) -> DataFrame:
        test, names = F.lit(False), ["_tested"]
        rows = read_once(rows, *PAIR)
        for plans, key, column in ((self.t.plans, "plans", "plan_id"),
                                   (self.t.investment_plans, "investment_plans", "investment_plan_id")):
            own = self(plans.select("id", F.col("user_id").cast("string").alias("_user")), "_user")
            bits = bits_for(self.t.rows(key))
            names.append(f"_members_{key}")
            rows = rows.withColumn(names[-1], bloom(own, "id", bits))
            test = test | may_hold(F.col(names[-1]), F.col(f"_tested.{column}"), bits)
        return rows.where(test).drop(*names)


def _matched_plan_users(tx: DataFrame) -> DataFrame:
    """User ids of the plan-kind branches: one per matched plan on the row."""
    ids = F.filter(F.array(
        F.when(F.col("has_investment_plan"), F.struct(F.col("ip_user_id").cast("string").alias("u"))),
        F.when(F.col("has_savings_plan"), F.struct(F.col("p_user_id").cast("string").alias("u"))),
    ), lambda s: s.isNotNull())
    return tx.select(F.explode(ids).alias("s")).select(F.col("s.u").alias("user_id"))


def recent_users(t: LedgerTables, window: Window) -> DataFrame:
    """Users whose last activity falls on a day of the window."""
    return (t.users.filter(window.day_between("most_recent_activity"))
            .select(F.col("id").cast("string").alias("user_id")))


INSIGHT_COLUMNS = ["user_id", "gender", "country", "dob", "status", "use_option",
                   "employment_status", "created_at", "is_recent", "is_active"]


def user_insights(t: LedgerTables, window: Window) -> DataFrame:
    """Users created in the window, one row per profile (a user with two
    profiles appears twice), flagged ``is_recent`` and ``is_active``."""
    return t.staged(("user_insights", window), lambda: _user_insights(t, window))


def _user_insights(t: LedgerTables, window: Window) -> DataFrame:
    cohort = (t.users.filter(window.ts_between("created_at"))
              .select(F.col("id"), F.col("id").cast("string").alias("user_id"),
                      "gender", "country", "dob", "status", "use_option", "created_at",
                      # the user row itself carries the recent-activity day
                      F.coalesce(window.day_between("most_recent_activity"), F.lit(False))
                      .alias("is_recent")))
    profiles = t.profiles.select(F.col("user_id").alias("pf_user_id"), "employment_status")
    keep = CohortFilter(t, cohort.select("user_id"))
    active = (_active_users(t, window, keep).filter(F.col("user_id").isNotNull())
              .select(F.col("user_id").alias("au_id"), F.lit(True).alias("_active")))
    return (cohort
            .join(profiles, cohort["id"] == profiles["pf_user_id"], "left")
            .join(active, F.col("user_id") == F.col("au_id"), "left")
            .withColumn("is_active", F.coalesce(F.col("_active"), F.lit(False)))
            .select(*INSIGHT_COLUMNS))


def user_kpis(t: LedgerTables, window: Window) -> DataFrame:
    """Rows of J8, and how many of them are active / recent."""
    return kpis_of(user_insights(t, window))


def kpis_of(insights: DataFrame) -> DataFrame:
    """J9 over an already computed (or stored) J8 / J10 frame."""
    return insights.agg(
        F.count(F.lit(1)).alias("registered_users"),
        F.count_if("is_active").alias("active_users"),
        F.count_if("is_recent").alias("users_with_most_recent_activity"))


def user_clean(t: LedgerTables, window: Window, as_of: dt.date) -> DataFrame:
    """J8 with labels normalised, birth date parsed, age and age group."""
    return t.staged(("user_clean", window, as_of), lambda: _user_clean(t, window, as_of))


def day_first(t: LedgerTables) -> Column:
    """Whether the users' birth dates of two numbers and a year have the day first: the vote of all that
    show it, as a scalar subquery; the month is first on a tie."""
    return day_first_of(t.users, "dob")


def day_first_of(rows: DataFrame, column: str) -> Column:
    votes = F.coalesce(F.sum(text.day_first_votes(F.col(column))), F.lit(0))
    return rows.agg((votes > 0).alias("day_first")).scalar()


def birth_dates(rows: DataFrame, as_of: dt.date, column: str = "dob") -> DataFrame:
    """``rows`` with ``dob_text`` (``column`` as it is), ``dob``, ``age`` and ``age_group``: the birth dates of any
    table, read by its own column's vote."""
    made = rows.withColumn("dob_text", F.col(column)).withColumn(
        "dob", text.birth_date(F.col("dob_text"), day_first_of(rows, column)))
    made = made.withColumn("age", text.age_on(F.col("dob"), as_of))
    return made.withColumn("age_group", text.age_group_label(F.col("age")))


def _user_clean(t: LedgerTables, window: Window, as_of: dt.date) -> DataFrame:
    return cleaned(user_insights(t, window), day_first(t), as_of)


def cleaned(insights: DataFrame, day_leads: Column, as_of: dt.date) -> DataFrame:
    """J10 over J8 rows.  Each of ``dob``, ``age`` and ``age_group`` is made from the finished one before."""
    rows = insights.withColumn("dob", text.birth_date(F.col("dob"), day_leads))
    rows = rows.withColumn("age", text.age_on(F.col("dob"), as_of))
    return rows.select(
        "user_id",
        text.clean_label(F.col("gender"), rd.GENDER_ALIASES).alias("gender"),
        text.strip(F.col("country")).alias("country"),
        "dob",
        text.clean_label(F.col("status"), rd.STATUS_ALIASES).alias("status"),
        text.clean_label(F.col("use_option"), rd.USE_OPTION_ALIASES).alias("use_option"),
        "employment_status", "created_at", "is_recent", "is_active", "age",
        text.age_group_label(F.col("age")).alias("age_group"))


def unparsed_birth_dates(t: LedgerTables, window: Window) -> DataFrame:
    """One row: J8 rows with a birth date text, and how many of them no format reads.

    A source in an unforeseen format shows here instead of as empty age bins."""
    given = F.col("dob").isNotNull()
    return user_insights(t, window).agg(
        F.count_if(given).alias("given"),
        F.count_if(given & text.birth_date(F.col("dob"), day_first(t)).isNull()).alias("unparsed"))


DISTRIBUTIONS = ("gender", "country", "use_option", "status", "employment_status")


def distribution(t: LedgerTables, window: Window, as_of: dt.date, column: str) -> DataFrame:
    """``column, count`` over non-NULL values, most frequent first."""
    return distribution_of(user_clean(t, window, as_of), column)


def distribution_of(clean: DataFrame, column: str) -> DataFrame:
    """J11 over an already computed (or stored) J10 frame."""
    if column not in DISTRIBUTIONS:
        raise ValueError(f"no distribution for {column!r}")
    return (clean
            .filter(F.col(column).isNotNull())
            .groupBy(column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(column)))


def age_distribution(t: LedgerTables, window: Window, as_of: dt.date) -> DataFrame:
    """All twelve age bins in order, empty ones with count 0."""
    return age_distribution_of(user_clean(t, window, as_of))


def age_distribution_of(clean: DataFrame) -> DataFrame:
    """J12 over an already computed (or stored) J10 frame: one conditional count a bin, a row in all."""
    width, lows = rd.AGE_BIN_WIDTH, [rd.AGE_BIN_FIRST + i * rd.AGE_BIN_WIDTH for i in range(rd.AGE_BIN_COUNT)]
    counts = clean.agg(*[F.count_if((F.col("age") >= lo) & (F.col("age") < lo + width)).alias(f"from_{lo}") for lo in lows])
    bins = F.array(*[F.struct(F.lit(f"[{lo}, {lo + width})").alias("age_group"), F.col(f"from_{lo}").alias("count")) for lo in lows])
    return counts.select(F.inline(bins))
