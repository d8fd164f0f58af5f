"""SQL twins of the registered queries, written independently for another engine.

Each twin is a final SELECT plus the named subqueries it needs, resolved from
``PARTS``. The models themselves have no SQL twin.
"""

from __future__ import annotations

import re

from checks.stages import (
    ADDITIVE, EXPLAINED_NOMINAL, EXPLAINED_NUMERIC, LOGISTIC, SCORECARD, STAND_INS,
)

# Fixed values, stated here again on purpose: a change in the library must turn its twins red.
RULES = [
    ("country_risk", "country_points",
     {"High": (20, "HIGH_RISK_COUNTRY"), "Medium": (8, "MEDIUM_RISK_COUNTRY")}),
    ("pep_status", "pep_points",
     {"Direct": (25, "DIRECT_PEP"), "Associate": (15, "PEP_ASSOCIATE")}),
    ("ubo_complexity", "ubo_points",
     {"Complex": (20, "COMPLEX_UBO_STRUCTURE"), "Moderate": (8, "MODERATE_UBO_COMPLEXITY")}),
    ("industry_risk", "industry_points",
     {"Cash Intensive": (15, "CASH_INTENSIVE_INDUSTRY"), "Elevated": (7, "ELEVATED_INDUSTRY_RISK")}),
    ("onboarding_channel", "channel_points", {"Remote": (5, "REMOTE_ONBOARDING")}),
    ("kyc_documentation", "documentation_points", {"Incomplete": (15, "INCOMPLETE_KYC_DOCUMENTATION")}),
]
ERFC_FIT = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
            -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
PROFILE_ATTRIBUTES = ["customer_type", "country_risk", "pep_status", "ubo_complexity", "industry_risk",
                      "onboarding_channel", "kyc_documentation"]
TESTED_CATEGORICAL = PROFILE_ATTRIBUTES + ["kyc_risk_rating"]
TESTED_NUMERIC = ["transaction_count", "counterparty_count", "transactions_per_active_day", "maximum_amount_zscore",
                  "cross_bank_ratio", "self_transfer_ratio", "unusually_large_tx_ratio", "incoming_outgoing_ratio",
                  "account_count", "bank_count", "currency_count", "payment_format_count"]
UNBOUNDED = ["transaction_count", "counterparty_count", "transactions_per_active_day", "incoming_outgoing_ratio",
             "account_count", "bank_count", "currency_count", "payment_format_count"]
MODEL_NUMERIC = ["log_transaction_count", "log_counterparty_count", "log_transactions_per_active_day",
                 "maximum_amount_zscore", "cross_bank_ratio", "self_transfer_ratio", "unusually_large_tx_ratio",
                 "log_incoming_outgoing_ratio", "log_account_count", "log_bank_count", "log_currency_count",
                 "log_payment_format_count"]
REASON_CHALLENGER = ("EBM provides material performance improvement while retaining acceptable calibration "
                     "and intrinsic interpretability.")
REASON_INCUMBENT = ("EBM does not provide enough additional value to justify its greater modelling and "
                    "validation complexity.")

TX_COLUMNS = ["transaction_timestamp", "from_bank_id", "from_account", "to_bank_id", "to_account",
              "round(amount_paid,4) as amount_paid", "round(amount_received,4) as amount_received",
              "payment_currency", "receiving_currency", "payment_format", "is_laundering",
              "transaction_date"]
ENTITY_COLUMNS = ["sender_entity_id", "sender_entity_name", "receiver_entity_id",
                  "receiver_entity_name"]


def _erfc(x: str) -> str:
    t = f"(1.0/(1.0+0.5*({x})))"
    poly = str(ERFC_FIT[0])
    for c in ERFC_FIT[1:]:
        poly = f"({poly}*{t}+({c}))"
    return f"({t}*exp({poly}-({x})*({x})))"


def _bucket(seed: int) -> str:
    return f"(('0x'||substr(md5(entity_id||':{seed}'),1,8))::bigint % 100)"


def _bank(x: str) -> str:
    return f"coalesce(cast(try_cast({x} as bigint) as varchar), trim({x}))"


def _points(factor: str, values: dict) -> str:
    cases = " ".join(f"when '{v}' then {p}" for v, (p, _) in values.items())
    return f"case {factor} {cases} else 0 end"


def _reason(factor: str, values: dict) -> str:
    cases = " ".join(f"when '{v}' then '{code}'" for v, (_, code) in values.items())
    return f"case {factor} {cases} end"


def _stand_in(model: str) -> str:
    intercept, weights = STAND_INS[model]
    margin = " + ".join(f"{c}*({w}::double)" for c, w in weights.items())
    return f"round(1.0/(1.0+exp(-(({intercept}::double) + {margin}))), 6)"


def _long(columns: list[str], source: str, kept: str, value: str, text: bool = False) -> str:
    kind = "varchar" if text else "double"
    return " union all ".join(
        f"select {kept}, '{c}' as feature, cast({c} as {kind}) as {value} from {source}"
        for c in columns)


PARTS: dict[str, str] = {
    "accounts_raw": """
        select 'Bank of '||n_name as "Bank Name", lpad(cast(c_nationkey as varchar),4,'0') as "Bank ID",
          ' c'||cast(c_custkey as varchar)||' ' as "Account Number",
          'E'||cast(c_custkey//8 as varchar) as "Entity ID",
          case when (c_custkey//8)%50=49 then 'Individual' when (c_custkey//8)%3=0 then 'Corporation'
               when (c_custkey//8)%3=1 then 'Partnership' else 'Sole Proprietorship' end
            ||' #'||cast(c_custkey//8 as varchar) as "Entity Name"
        from customer join nation on c_nationkey=n_nationkey where c_custkey%97<>96
        union all
        select 'Bank of '||n_name, cast(s_nationkey as varchar), 'S'||cast(s_suppkey as varchar),
          'E'||cast(s_suppkey as varchar),
          case when s_suppkey%50=49 then 'Individual' when s_suppkey%3=0 then 'Corporation'
               when s_suppkey%3=1 then 'Partnership' else 'Sole Proprietorship' end
            ||' #'||cast(s_suppkey as varchar)
        from supplier join nation on s_nationkey=n_nationkey""",
    "tx_base": """
        select *, (o_custkey//8)%9=0 as hot,
          case when (l_orderkey*31+l_linenumber*17)%100
                 < case when (o_custkey//8)%9=0 then 10 else 2 end then 100.0 else 1.0 end::double as k
        from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
          join supplier on l_suppkey=s_suppkey""",
    "tx_once": """
        select strftime(l_shipdate + to_minutes(cast((l_orderkey*7+l_linenumber*13)%1440 as int)),
                 '%Y/%m/%d %H:%M') as "Timestamp",
          lpad(cast(c_nationkey as varchar),4,'0') as "From Bank", 'C'||cast(c_custkey as varchar) as "Account2",
          cast(s_nationkey as varchar) as "To Bank", 's'||cast(s_suppkey as varchar) as "Account4",
          l_extendedprice*k*(1-l_discount) as "Amount Received",
          case s_nationkey%5 when 0 then 'USD' when 1 then 'EUR' when 2 then 'JPY' when 3 then 'GBP' else 'CNY' end as "Receiving Currency",
          case when l_orderkey%1000=7 then null else l_extendedprice*k end as "Amount Paid",
          case c_nationkey%5 when 0 then 'USD' when 1 then 'EUR' when 2 then 'JPY' when 3 then 'GBP' else 'CNY' end as "Payment Currency",
          o_orderpriority as "Payment Format",
          case when l_returnflag='R' and l_discount=0.1 and l_tax >= case when hot then 0.03 else 0.08 end then 1 else 0 end as "Is Laundering",
          l_orderkey
        from tx_base""",
    "transactions_raw": """
        select * exclude (l_orderkey) from tx_once
        union all select * exclude (l_orderkey) from tx_once where l_orderkey%500=0""",
    "acc_clean": f"""
        select trim("Bank Name") as bank_name, {_bank('"Bank ID"')} as bank_id,
          upper(trim("Account Number")) as account_number, trim("Entity ID") as entity_id,
          trim("Entity Name") as entity_name from accounts_raw""",
    "accounts": """
        select bank_name, bank_id, account_number, entity_id, entity_name from (
          select *, row_number() over (partition by bank_id, account_number
            order by bank_name, entity_id, entity_name) as rn from acc_clean) where rn=1""",
    "tx": f"""
        select strptime("Timestamp", '%Y/%m/%d %H:%M') as transaction_timestamp,
          {_bank('"From Bank"')} as from_bank_id, upper(trim("Account2")) as from_account,
          {_bank('"To Bank"')} as to_bank_id, upper(trim("Account4")) as to_account,
          "Amount Paid" as amount_paid, "Amount Received" as amount_received,
          trim("Payment Currency") as payment_currency, trim("Receiving Currency") as receiving_currency,
          trim("Payment Format") as payment_format, cast("Is Laundering" as int) as is_laundering,
          cast(strptime("Timestamp", '%Y/%m/%d %H:%M') as date) as transaction_date
        from transactions_raw""",
    "enr": """
        select t.*, s.entity_id as sender_entity_id, s.entity_name as sender_entity_name,
          r.entity_id as receiver_entity_id, r.entity_name as receiver_entity_name
        from tx t
        left join accounts s on t.from_bank_id=s.bank_id and t.from_account=s.account_number
        left join accounts r on t.to_bank_id=r.bank_id and t.to_account=r.account_number""",
    "obs": "select * from enr where transaction_date between date '1995-01-01' and date '1999-12-31'",
    "outc": "select * from enr where transaction_date between date '2000-01-01' and date '2000-12-31'",
    "pop": """
        select entity_id, min(entity_name) as entity_name from (
          select sender_entity_id as entity_id, sender_entity_name as entity_name from obs
          union all select receiver_entity_id, receiver_entity_name from obs)
        where entity_id is not null group by entity_id""",
    "posi": """
        select distinct entity_id, 1 as future_aml_event from (
          select sender_entity_id as entity_id from outc where is_laundering=1
          union all select receiver_entity_id from outc where is_laundering=1)
        where entity_id is not null""",
    "target": """
        select p.entity_id, p.entity_name, coalesce(q.future_aml_event, 0) as future_aml_event
        from pop p left join posi q on p.entity_id=q.entity_id""",
    "base": """
        select a.entity_id, a.entity_name, a.account_count, a.bank_count, t.future_aml_event from (
          select entity_id, min(entity_name) as entity_name,
            count(distinct account_number) as account_count, count(distinct bank_id) as bank_count
          from accounts group by entity_id) a join target t on a.entity_id=t.entity_id""",
    "prof": f"""
        select *,
          case when contains(entity_name,'Corporation') then 'Corporation'
               when contains(entity_name,'Partnership') then 'Partnership'
               when contains(entity_name,'Sole Proprietorship') then 'Sole Proprietorship'
               else 'Other' end as customer_type,
          case when {_bucket(101)}<75 then 'Low' when {_bucket(101)}<95 then 'Medium' else 'High' end as country_risk,
          case when {_bucket(202)}<97 then 'None' when {_bucket(202)}<99 then 'Associate' else 'Direct' end as pep_status,
          case when {_bucket(303)}<70 then 'Simple' when {_bucket(303)}<92 then 'Moderate' else 'Complex' end as ubo_complexity,
          case when {_bucket(404)}<65 then 'Standard' when {_bucket(404)}<90 then 'Elevated' else 'Cash Intensive' end as industry_risk,
          case when {_bucket(505)}<70 then 'Branch' else 'Remote' end as onboarding_channel,
          case when {_bucket(606)}<92 then 'Complete' else 'Incomplete' end as kyc_documentation
        from base""",
    "pointed": "select *, " + ", ".join(
        f"{_points(f, v)} as {c}" for f, c, v in RULES) + ", array_to_string(list_filter(["
        + ", ".join(_reason(f, v) for f, _, v in RULES)
        + "], lambda x: x is not null), '|') as reason_codes from prof",
    "summed": "select *, " + "+".join(c for _, c, _ in RULES) + " as kyc_risk_score from pointed",
    "scored": """select *, case when kyc_risk_score>=35 then 'HIGH' when kyc_risk_score>=15 then 'MEDIUM'
        else 'LOW' end as kyc_risk_rating from summed""",
    "ids": """select *, row(transaction_timestamp, from_bank_id, from_account, to_bank_id, to_account,
        amount_paid, amount_received, payment_currency, receiving_currency, payment_format) as tid
        from obs""",
    "ev": """
        select tid, transaction_date, payment_format, sender_entity_id as entity_id,
          receiver_entity_id as counterparty_entity_id, from_bank_id as entity_bank_id,
          to_bank_id as counterparty_bank_id, 'OUT' as direction, amount_paid as amount,
          payment_currency as currency from ids where sender_entity_id is not null
        union all
        select tid, transaction_date, payment_format, receiver_entity_id, sender_entity_id, to_bank_id,
          from_bank_id, 'IN', amount_received, receiving_currency from ids
        where receiver_entity_id is not null""",
    "cur": """select currency, avg(ln(coalesce(amount,0)+1)) as currency_mean,
        stddev_samp(ln(coalesce(amount,0)+1)) as currency_std from ev group by currency""",
    "evz": """
        select e.*, case when c.currency_std is null or c.currency_std=0 then 0.0
            else (ln(coalesce(amount,0)+1)-c.currency_mean)/c.currency_std end as amount_zscore,
          cast(entity_bank_id<>counterparty_bank_id as int) as is_cross_bank,
          cast(entity_id=counterparty_entity_id as int) as is_self_transfer
        from ev e left join cur c on e.currency=c.currency""",
    "act": """
        select entity_id, count(distinct tid) as transaction_count,
          count(distinct tid) filter (where direction='OUT') as outgoing_tx_count,
          count(distinct tid) filter (where direction='IN') as incoming_tx_count,
          count(distinct tid) filter (where amount_zscore>=2.5) as unusually_large_tx_count,
          count(distinct tid) filter (where is_cross_bank=1) as cross_bank_tx_count,
          count(distinct tid) filter (where is_self_transfer=1) as self_transfer_tx_count,
          count(distinct transaction_date) as active_days,
          count(distinct counterparty_entity_id) filter (where counterparty_entity_id<>entity_id) as counterparty_count,
          count(distinct counterparty_bank_id) as counterparty_bank_count,
          count(distinct currency) as currency_count,
          count(distinct payment_format) as payment_format_count,
          avg(amount_zscore) as average_amount_zscore, max(amount_zscore) as maximum_amount_zscore
        from evz group by entity_id""",
    "filled": "select s.*, " + ", ".join(
        f"coalesce(a.{c}, 0) as {c}" for c in [
            "transaction_count", "outgoing_tx_count", "incoming_tx_count",
            "unusually_large_tx_count", "cross_bank_tx_count", "self_transfer_tx_count",
            "active_days", "counterparty_count", "counterparty_bank_count", "currency_count",
            "payment_format_count", "average_amount_zscore", "maximum_amount_zscore"])
        + " from scored s left join act a on s.entity_id=a.entity_id",
    "feat": """
        select *, case when active_days>0 then transaction_count/active_days else 0.0 end as transactions_per_active_day,
          (incoming_tx_count+1.0)/(outgoing_tx_count+1.0)::double as incoming_outgoing_ratio,
          case when transaction_count>0 then cross_bank_tx_count/transaction_count else 0.0 end as cross_bank_ratio,
          case when transaction_count>0 then self_transfer_tx_count/transaction_count else 0.0 end as self_transfer_ratio,
          case when transaction_count>0 then unusually_large_tx_count/transaction_count else 0.0 end as unusually_large_tx_ratio
        from filled""",
    "num_long": _long(TESTED_NUMERIC, "feat", "future_aml_event as y", "v"),
    "num_ranked": """
        select feature, y, v, rank() over (partition by feature order by v)
          + (count(*) over (partition by feature, v) - 1)/2.0 as r,
          count(*) over (partition by feature, v) as tied from num_long""",
    "num_u": """
        select feature, sum(case when y=1 then r end)::double as rank_sum,
          count(*) filter (where y=1)::double as n1, count(*) filter (where y=0)::double as n0,
          sum(tied::double*tied-1) as tie_term,
          median(v) filter (where y=1) as positive_median,
          median(v) filter (where y=0) as negative_median
        from num_ranked group by feature""",
    "num_z": """
        select *, rank_sum-n1*(n1+1)/2 as u, n1+n0 as n,
          n1*n0/12*(n1+n0+1-tie_term/((n1+n0)*(n1+n0-1))) as variance from num_u""",
    "num_tests": f"""
        select feature, positive_median, negative_median,
          least(1.0, {_erfc("greatest((greatest(u,n1*n0-u)-n1*n0/2-0.5)/sqrt(variance),0)/sqrt(2.0::double)")}) as p_value,
          2*u/(n1*n0)-1 as rank_biserial_effect from num_z""",
    "cat_long": _long(TESTED_CATEGORICAL, "feat", "future_aml_event as y", "level", text=True),
    "cont": """
        select feature, level, count(*) filter (where y=0) as negatives,
          count(*) filter (where y=1) as positives from cat_long group by feature, level""",
    "cont_m": """
        select *, (negatives+positives)::double as r,
          (sum(negatives) over (partition by feature))::double as c0,
          (sum(positives) over (partition by feature))::double as c1,
          count(*) over (partition by feature) as levels from cont""",
    "chi": """
        select feature, max(levels)-1 as dof, max(c0+c1) as n,
          sum(case when levels=2 then
               pow(greatest(abs(negatives-r*c0/(c0+c1))-0.5,0),2)/(r*c0/(c0+c1))
             + pow(greatest(abs(positives-r*c1/(c0+c1))-0.5,0),2)/(r*c1/(c0+c1))
             else pow(negatives-r*c0/(c0+c1),2)/(r*c0/(c0+c1))
             + pow(positives-r*c1/(c0+c1),2)/(r*c1/(c0+c1)) end) as chi_square
        from cont_m group by feature""",
    "frame0": "select entity_id, future_aml_event, kyc_risk_score/100.0::double as scorecard_score, "
        + ", ".join(
            f"ln(1+greatest({s}::double,0)) as {m}" if s in UNBOUNDED
            else f"least(greatest({s}::double,-5),10) as {m}" if s == "maximum_amount_zscore"
            else f"{s}::double as {m}" for s, m in zip(TESTED_NUMERIC, MODEL_NUMERIC))
        + ", " + ", ".join(f"coalesce({c},'Unknown') as {c}" for c in PROFILE_ATTRIBUTES)
        + " from feat",
    "frame": """
        select * exclude (n_before, n_total), case when n_before < n_total*0.6::double then 'train'
            when n_before < n_total*0.8::double then 'validation' else 'test' end as split
        from (select *, rank() over (partition by future_aml_event
                order by ('0x'||substr(md5(entity_id||':42'),1,15))::bigint) - 1 as n_before,
              count(*) over (partition by future_aml_event) as n_total from frame0)""",
    "wide": f"""select *, {_stand_in(LOGISTIC)} as logistic_probability,
        {_stand_in(ADDITIVE)} as ebm_probability from frame""",
    "long_scores": f"""
        select split, entity_id, future_aml_event as y, '{SCORECARD}' as model, scorecard_score as score from wide where split<>'train'
        union all select split, entity_id, future_aml_event, '{LOGISTIC}', logistic_probability from wide where split<>'train'
        union all select split, entity_id, future_aml_event, '{ADDITIVE}', ebm_probability from wide where split<>'train'""",
    "thr": """select model, quantile_cont(score, 0.9) as threshold from long_scores
        where split='validation' group by model""",
    "test": "select * from long_scores where split='test'",
    "flags": """
        select t.model, max(threshold) as threshold, count(*)::double as n, sum(y)::double as pos,
          count(*) filter (where score>=threshold)::double as flagged,
          count(*) filter (where score>=threshold and y=1)::double as hits, avg(pow(score-y,2)) as sq
        from test t join thr on t.model=thr.model group by t.model""",
    "cap": f"""
        select model, threshold, flagged/n as test_review_rate,
          case when flagged>0 then hits/flagged else 0 end as precision_at_capacity,
          case when pos>0 then hits/pos else 0 end as recall_at_capacity,
          (case when flagged>0 then hits/flagged else 0 end)/(pos/n) as lift_at_capacity,
          case when model<>'{SCORECARD}' then sq end as brier_score from flags""",
    "points_pr": """
        select model, score, sum(y)::double as pos, count(*)::double-sum(y) as neg,
          (sum(sum(y)) over w)::double as tp, (sum(count(*)) over w)::double as flagged
        from test group by model, score window w as (partition by model order by score desc)""",
    "areas": """
        select a.model, a.pr_auc, b.roc_auc from
          (select model, sum(tp/flagged*pos)/sum(pos) as pr_auc from points_pr group by model) a
          join (select model, (sum(r) filter (where y=1)-max(n1)*(max(n1)+1)/2)/(max(n1)*max(n0)) as roc_auc
                from (select model, y, (rank() over (partition by model order by score)
                        +(count(*) over (partition by model, score)-1)/2.0)::double as r,
                      (sum(y) over (partition by model))::double as n1,
                      (sum(1-y) over (partition by model))::double as n0 from test)
                group by model) b on a.model=b.model""",
    "comparison": """
        select c.model, threshold, test_review_rate, pr_auc, roc_auc, precision_at_capacity,
          recall_at_capacity, lift_at_capacity, brier_score
        from cap c join areas a on c.model=a.model""",
    "edges": """select model, quantile_cont(score, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as edges
        from test group by model""",
}


def _needed(sql: str) -> list[str]:
    """Names of the parts a statement refers to, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+([a-z_0-9]+)", text):
            if name in PARTS and name not in found:
                visit(PARTS[name])
                found.append(name)

    visit(sql)
    return found


def statement(sql: str) -> str:
    parts = _needed(sql)
    if not parts:
        return sql
    return "with " + ",\n".join(f"{p} as ({PARTS[p]})" for p in parts) + "\n" + sql


def _rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c},{digits}) as {c}" for c in columns)


METRICS = ["threshold", "test_review_rate", "pr_auc", "roc_auc", "precision_at_capacity",
           "recall_at_capacity", "lift_at_capacity", "brier_score"]
CAP_METRICS = [m for m in METRICS if m not in ("pr_auc", "roc_auc")]
FEATURE_DOUBLES = ["average_amount_zscore", "maximum_amount_zscore", "transactions_per_active_day",
                   "incoming_outgoing_ratio", "cross_bank_ratio", "self_transfer_ratio",
                   "unusually_large_tx_ratio"]
RAW_COLUMNS = ["Timestamp", "From Bank", "Account2", "To Bank", "Account4", "Amount Received",
               "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format",
               "Is Laundering"]
_GAIN = """(select max(case when model='{c}' then {m} end)-max(case when model='{i}' then {m} end)
    from comparison)"""


def _gain(metric: str) -> str:
    return _GAIN.format(c=ADDITIVE, i=LOGISTIC, m=metric)


_BRIER = f"""(select max(case when model='{ADDITIVE}' then brier_score end)
    <= max(case when model='{LOGISTIC}' then brier_score end)*1.1::double from comparison)"""
_WINS = f"{_gain('recall_at_capacity')}>=0.05 and {_gain('pr_auc')}>=0.02 and {_BRIER}"

FINAL: dict[str, str] = {
    "csv_transactions": """select "Payment Format", "Payment Currency", count(*) as n,
        round(sum("Amount Received"),2) as received, cast(sum("Is Laundering") as bigint) as labelled,
        min("Timestamp") as first_seen from transactions_raw group by 1, 2""",
    "csv_accounts": "select * from accounts_raw",
    "csv_quarantine": """select count(*) as rows_read, count(*) - count_if(faulty) as rows_parsed,
        count_if(faulty) as rows_quarantined from (
          select cast(substr("Account2",2) as bigint) % 17 = 0 or cast(substr("Account2",2) as bigint) % 23 = 0
            as faulty from transactions_raw)""",
    "text_lines": """select "Entity ID"||' -> '||"Bank ID" as value, count(*) as n
        from accounts_raw group by 1""",
    "table_overwrite": """select payment_currency, count(*) as n, cast(sum(is_laundering) as bigint) as labelled,
        max(transaction_date) as last_day from tx group by 1""",
    "result_csv": """select is_laundering as label, count(*) as n,
        round(count(*)/sum(count(*)) over ()*100,4) as percentage from tx group by 1""",
    "input_row_counts": """select 'transactions' as input, count(*) as row_count from transactions_raw
        union all select 'accounts', count(*) from accounts_raw""",
    "audit_label_distribution": """select "Is Laundering" as label, count(*) as count,
        round(count(*)/sum(count(*)) over ()*100,4) as percentage from transactions_raw group by 1""",
    "audit_time_range": """select min("Timestamp") as minimum_timestamp,
        max("Timestamp") as maximum_timestamp from transactions_raw""",
    "audit_null_counts": " union all ".join(
        f"""select '{c}' as column_name, count(*)-count("{c}") as null_count from transactions_raw"""
        for c in RAW_COLUMNS),
    "audit_record": """select 'orders' as dataset, (select count(*) from transactions_raw) as transaction_rows,
        (select count(*) from accounts_raw) as account_rows, 11 as transaction_columns,
        5 as account_columns, 'Is Laundering' as label_column, 'Timestamp' as timestamp_column""",
    "ambiguous_accounts": """select bank_id, account_number, count(distinct entity_id) as entity_count,
        count(*) as row_count from acc_clean group by 1, 2 having count(distinct entity_id)>1""",
    "ambiguous_banks": """select bank_id, count(distinct entity_id) as entity_count,
        count(*) as row_count from acc_clean group by 1 having count(distinct entity_id)>1""",
    "customer_accounts": "select * from accounts",
    "mapping_summary": """
        select *, round((1-unmatched_senders/transactions)*100,4) as sender_match_percentage,
          round((1-unmatched_receivers/transactions)*100,4) as receiver_match_percentage from (
        select count(*) as transactions,
          count(*) filter (where sender_entity_id is null) as unmatched_senders,
          count(*) filter (where receiver_entity_id is null) as unmatched_receivers,
          count(distinct sender_entity_id) as distinct_sender_entities,
          count(distinct receiver_entity_id) as distinct_receiver_entities,
          min(transaction_timestamp) as minimum_timestamp,
          max(transaction_timestamp) as maximum_timestamp from enr)""",
    "accounts_per_entity": """select entity_id, entity_name, count(*) as account_count,
        count(distinct bank_id) as bank_count from accounts group by 1, 2
        order by account_count desc, entity_id, entity_name limit 20""",
    "daily_profile": """select transaction_date, count(*) as transactions,
        cast(sum(is_laundering) as bigint) as laundering_transactions,
        count(distinct sender_entity_id) as sender_entities,
        count(distinct receiver_entity_id) as receiver_entities,
        round(sum(is_laundering)/count(*)*100,4) as laundering_percentage from enr group by 1""",
    "clean_accounts": "select * from acc_clean",
    "clean_transactions": f"select {', '.join(TX_COLUMNS)} from tx",
    "enriched_transactions": f"select {', '.join(TX_COLUMNS + ENTITY_COLUMNS)} from enr",
    "observation_transactions": f"select {', '.join(TX_COLUMNS + ENTITY_COLUMNS)} from obs",
    "population": "select * from pop",
    "future_positives": "select * from posi",
    "population_target": "select * from target",
    "target_summary": """select future_aml_event, count(*) as count,
        round(count(*)/sum(count(*)) over ()*100,4) as percentage from target group by 1""",
    "profile_base": "select * from base",
    "profile_md5": "select * from prof",
    "customer_type_counts": "select customer_type, count(*) as count from prof group by 1",
    "attribute_distribution": "select attribute, value, count, round(count/n*100,2) as percentage from ("
        + " union all ".join(
            f"select '{c}' as attribute, {c} as value, count(*) as count from prof group by {c}"
            for c in PROFILE_ATTRIBUTES) + ") cross join (select count(*) as n from prof)",
    "scorecard_points": "select * exclude (reason_codes) from scored",
    "reason_codes": "select entity_id, reason_codes from scored",
    "rating_distribution": """select kyc_risk_rating, count(*) as customers,
        round(avg(kyc_risk_score),2) as average_score,
        round(count(*)/sum(count(*)) over ()*100,2) as percentage from scored group by 1""",
    "rating_outcomes": """select kyc_risk_rating, count(*) as customers,
        cast(sum(future_aml_event) as bigint) as future_positive_customers,
        round(avg(future_aml_event)*100,4) as future_positive_rate from scored group by 1""",
    "top_high_risk": """select entity_id, entity_name, customer_type, kyc_risk_score, kyc_risk_rating,
        reason_codes, future_aml_event from scored where kyc_risk_rating='HIGH'
        order by kyc_risk_score desc, entity_id limit 20""",
    "transaction_ids": """select payment_format, cast(sum(c) as bigint) as n, count(*) as distinct_ids,
        max(c) as most_copies from (select tid, payment_format, count(*) as c from ids group by 1, 2)
        group by 1""",
    "directional_events": "select * exclude (tid, amount), round(amount,4) as amount from ev",
    "currency_statistics": """select currency, round(currency_mean,6) as currency_mean,
        round(currency_std,6) as currency_std from cur""",
    "amount_zscore": """select entity_id, transaction_date, direction, currency,
        round(amount_zscore,4) as amount_zscore, is_cross_bank, is_self_transfer from evz""",
    "customer_activity": f"""select * exclude (average_amount_zscore, maximum_amount_zscore),
        {_rounded(["average_amount_zscore", "maximum_amount_zscore"])} from act""",
    "customer_features":
        f"select * exclude ({', '.join(FEATURE_DOUBLES)}), {_rounded(FEATURE_DOUBLES)} from feat",
    "feature_means": """select future_aml_event, count(*) as customers,
        round(avg(transaction_count),2) as avg_transaction_count,
        round(avg(counterparty_count),2) as avg_counterparty_count,
        round(avg(transactions_per_active_day),2) as avg_transactions_per_day,
        round(avg(maximum_amount_zscore),3) as avg_maximum_amount_zscore,
        round(avg(cross_bank_ratio),4) as avg_cross_bank_ratio,
        round(avg(self_transfer_ratio),4) as avg_self_transfer_ratio,
        round(avg(account_count),2) as avg_account_count,
        round(avg(bank_count),2) as avg_bank_count from feat group by 1""",
    "median_comparison": "select future_aml_event, " + ", ".join(
        f"round(quantile_disc({c},0.5),6) as median_{c}"
        if c in ("transactions_per_active_day", "maximum_amount_zscore") or c.endswith("ratio")
        else f"quantile_disc({c},0.5) as median_{c}" for c in TESTED_NUMERIC)
        + " from feat group by 1",
    "mann_whitney": f"""select feature, {_rounded(["positive_median", "negative_median", "p_value",
        "rank_biserial_effect"])}, round(least(1.0, p_value*12),6) as adjusted_p_value,
        round(abs(rank_biserial_effect),6) as absolute_effect from num_tests""",
    "effect_labels": """select feature, case when abs(rank_biserial_effect)<0.1 then 'negligible'
        when abs(rank_biserial_effect)<0.3 then 'small' when abs(rank_biserial_effect)<=0.5 then 'moderate'
        else 'strong' end as effect_size from num_tests""",
    "contingency_tables": "select * from cont",
    "chi_square": f"""select feature, round(chi_square,6) as chi_square,
        round(least(1.0, case dof when 1 then {_erfc("sqrt(chi_square/2)")} when 2 then exp(-chi_square/2)
          when 3 then {_erfc("sqrt(chi_square/2)")}+exp(-chi_square/2)*2*sqrt(chi_square/2)/sqrt(pi())
          end),6) as p_value, round(sqrt(chi_square/n),6) as cramers_v from chi""",
    "model_frame": f"""select entity_id, future_aml_event, {_rounded(["scorecard_score"] + MODEL_NUMERIC)},
        {', '.join(PROFILE_ATTRIBUTES)} from frame0""",
    "stratified_split": "select entity_id, future_aml_event, split from frame",
    "split_summary": """select split, count(*) as customers,
        cast(sum(future_aml_event) as bigint) as positives from frame group by 1""",
    "standard_scaling": "select entity_id, " + ", ".join(
        f"""round(({c}-(select avg({c}) from frame where split='train'))
          /coalesce(nullif((select stddev_pop({c}) from frame where split='train'),0),1),4) as {c}"""
        for c in MODEL_NUMERIC) + " from frame",
    "one_hot_inputs": " union all ".join(
        f"""select entity_id, '{c}_'||{c} as term, 1.0::double as value from frame
          where {c} in (select {c} from frame where split='train')""" for c in PROFILE_ATTRIBUTES),
    "logistic_optimality": "select unnest([" + ", ".join(f"'{c}'" for c in MODEL_NUMERIC) + """]) as term,
        true as at_optimum union all select '(intercept)', true """ + " ".join(
        f"""union all select distinct '{c}_'||{c}, true from frame where split='train'"""
        for c in PROFILE_ATTRIBUTES),
    "logistic_balance": """select count(*) as customers, round(sum(future_aml_event)::double,1) as expected_positives
        from frame where split='train'""",
    "logistic_margins": "select entity_id, split, true as agrees from frame",
    "additive_fit_checks": "select unnest([" + ", ".join(
        f"'{c}'" for c in MODEL_NUMERIC + PROFILE_ATTRIBUTES + ["hold-out loss"]) + "]) as subject, true as holds",
    "additive_margins": "select entity_id, split, true as agrees from frame",
    "importance_agreement": "select unnest([" + ", ".join(
        f"'{c}'" for c in MODEL_NUMERIC + PROFILE_ATTRIBUTES) + "]) as feature, true as agrees",
    "capacity_threshold_stand_in": "select model, round(threshold,6) as threshold from thr",
    "capacity_metrics_stand_in": f"select model, {_rounded(CAP_METRICS)} from cap",
    "curve_areas_stand_in": f"select model, {_rounded(['pr_auc', 'roc_auc'])} from areas",
    "pr_curve_stand_in": """select model, round(score,6) as threshold, round(tp/flagged,6) as precision,
        round(tp/(sum(pos) over (partition by model)),6) as recall from points_pr
        union all select distinct model, null, 1.0, 0.0 from test""",
    "prevalence_stand_in": "select model, round(avg(y),6) as prevalence from test group by 1",
    "probability_summary_stand_in": """select model, round(min(score),6) as minimum,
        round(median(score),6) as median, round(quantile_cont(score,0.95),6) as p95,
        round(quantile_cont(score,0.99),6) as p99, round(max(score),6) as maximum
        from test group by 1""",
    "calibration_stand_in": """select t.model, len(list_filter(edges, lambda e: e < score)) as bin,
        count(*) as customers, round(avg(score),6) as mean_predicted, round(avg(y),6) as observed_rate
        from test t join edges e on t.model=e.model group by 1, 2""",
    "model_comparison_stand_in": f"select model, {_rounded(METRICS)} from comparison",
    "metric_chart_stand_in": " union all ".join(
        f"select model, '{m}' as metric, round({m},6) as value from comparison"
        for m in ("pr_auc", "recall_at_capacity", "precision_at_capacity")),
    "test_predictions_stand_in": f"""select entity_id, future_aml_event,
        {_rounded(["scorecard_score", "logistic_probability", "ebm_probability"])}
        from wide where split='test'""",
    "top_true_positive_stand_in": """select entity_id, ebm_probability from wide
        where split='test' and future_aml_event=1 order by ebm_probability desc, entity_id limit 1""",
    "local_explanation_stand_in": """
        select entity_id, row_number() over (partition by entity_id order by contribution, feature) as place,
          feature, contribution from (
            select *, row_number() over (partition by entity_id order by abs(contribution) desc, feature) as rn
            from (""" + " union all ".join(
                f"select entity_id, '{c}' as feature, round({value}*({w}::double),6) as contribution from frame"
                for c, value, w in [(c, c, w) for c, w in EXPLAINED_NUMERIC.items()]
                + [(c, f"length({c})", w) for c, w in EXPLAINED_NOMINAL.items()]) + """)) where rn<=10""",
    "champion_decision_stand_in": f"""select round({_gain('recall_at_capacity')},6) as recall_improvement,
        round({_gain('pr_auc')},6) as pr_auc_improvement, {_BRIER} as calibration_acceptable,
        case when {_WINS} then '{ADDITIVE}' else '{LOGISTIC}' end as champion,
        case when {_WINS} then '{REASON_CHALLENGER}' else '{REASON_INCUMBENT}' end
          as decision_reason""",
}

ORACLES = {name: statement(sql) for name, sql in FINAL.items()}
