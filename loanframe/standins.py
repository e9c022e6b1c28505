"""The generated tables in the shape of statements, applications and loan history.

Each stand-in is one SELECT in the dialect that Spark and the checking database share, so both
sides of a check start from the same rows. ``{name}`` is a generated table or another stand-in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loanframe.session import scratch_path

STANDINS: dict[str, str] = {}

STANDINS["bank"] = """
SELECT user_id, CAST(ts AS DATE) AS date,
  CASE WHEN event_type = 'signup' THEN value * 10 ELSE CAST(0 AS DOUBLE) END AS income,
  CASE WHEN event_type = 'signup' THEN CAST(0 AS DOUBLE) ELSE value END AS expense,
  value - CAST(20 AS DOUBLE) AS balance,
  CASE event_type WHEN 'signup' THEN 'Salary' WHEN 'click' THEN 'Bill Payment'
    WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN NULL ELSE 'CREDIT card payment 12' END
    ELSE 'ATM Withdrawal' END AS description,
  event_id AS ord
FROM {events} WHERE event_type <> 'purchase'
"""

STANDINS["card"] = """
SELECT user_id, CAST(ts AS DATE) AS date,
  CONCAT('Shop ', CAST(event_id % 97 AS STRING)) AS business_name,
  value * 2 AS amount_of_deal, value AS amount_paid,
  CASE event_id % 9 WHEN 0 THEN 'Groceries' WHEN 1 THEN 'Dining' WHEN 2 THEN 'Travel'
    WHEN 3 THEN 'Electronics' WHEN 4 THEN 'Clothing' WHEN 5 THEN 'Entertainment'
    WHEN 6 THEN 'Health' WHEN 7 THEN 'Home' ELSE NULL END AS category
FROM {events} WHERE event_type IN ('purchase', 'view')
"""

STANDINS["account_bank"] = """
SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END AS income,
  CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS expense,
  o_totalprice - CAST(90000 AS DOUBLE) AS balance,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Credit Card Payment' ELSE 'Bill Payment' END
    AS description,
  o_orderkey AS ord
FROM {orders}
"""

STANDINS["account_card"] = """
SELECT o.o_custkey AS user_id, CAST(l.l_shipdate AS DATE) AS date,
  l.l_extendedprice AS amount_paid,
  CASE l.l_linenumber WHEN 1 THEN 'Groceries' WHEN 2 THEN 'Dining' WHEN 3 THEN 'Travel'
    WHEN 4 THEN 'Electronics' WHEN 5 THEN 'Clothing' WHEN 6 THEN 'Entertainment'
    ELSE 'Health' END AS category
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

STANDINS["accepted"] = """
SELECT o.o_orderkey AS loan_key, o.o_totalprice / 10 AS loan_amnt,
  CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS issue_d, o.o_orderpriority AS title,
  CASE WHEN o.o_orderkey % 50 = 7 THEN NULL ELSE CAST(o.o_orderkey % 400 AS DOUBLE) / 10 END AS dti,
  CASE o.o_orderkey % 7 WHEN 0 THEN '< 1 year' WHEN 1 THEN '10+ years' WHEN 2 THEN '3 years'
    WHEN 3 THEN 'n/a' WHEN 4 THEN '1-2 years' WHEN 5 THEN NULL ELSE '7 years' END AS emp_length,
  CAST(1 AS DOUBLE) AS policy_code, CAST(600 + o.o_custkey % 250 AS DOUBLE) AS fico_range_high,
  CASE WHEN o.o_orderkey % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
  CAST(5 + (o.o_custkey % 40) / 4 + (o.o_orderkey % 3) AS DOUBLE) AS int_rate,
  o.o_totalprice / 360 AS installment,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS grade,
  'A1' AS sub_grade,
  CASE o.o_custkey % 6 WHEN 0 THEN 'Registered Nurse' WHEN 1 THEN 'Software Engineer'
    WHEN 2 THEN 'Truck Driver' WHEN 3 THEN 'Senior Software Engineer' WHEN 4 THEN 'Nurse, night shift'
    ELSE NULL END AS emp_title,
  CASE c.c_mktsegment WHEN 'FURNITURE' THEN 'RENT' WHEN 'MACHINERY' THEN 'MORTGAGE'
    WHEN 'BUILDING' THEN 'OWN' WHEN 'AUTOMOBILE' THEN 'NONE' ELSE 'ANY' END AS home_ownership,
  (c.c_acctbal + 1000) * 10 AS annual_inc,
  CASE o.o_orderkey % 11 WHEN 0 THEN 'Fully Paid' WHEN 1 THEN 'Charged Off' WHEN 2 THEN 'Current'
    WHEN 3 THEN 'Default' WHEN 4 THEN 'Late (31-120 days)' WHEN 5 THEN 'Late (16-30 days)'
    WHEN 6 THEN 'In Grace Period'
    WHEN 7 THEN 'Does not meet the credit policy. Status:Fully Paid'
    WHEN 8 THEN NULL WHEN 9 THEN 'Fully Paid' ELSE 'Fully Paid' END AS loan_status,
  CASE o.o_orderkey % 13 WHEN 0 THEN 'car' WHEN 1 THEN 'credit_card'
    WHEN 2 THEN 'debt consolidation' WHEN 3 THEN 'educational' WHEN 4 THEN 'home improvement'
    WHEN 5 THEN 'house' WHEN 6 THEN 'major purchase' WHEN 7 THEN 'medical' WHEN 8 THEN 'moving'
    WHEN 9 THEN 'other' WHEN 10 THEN 'small business' WHEN 11 THEN 'vacation' ELSE 'wedding' END
    AS purpose,
  CAST(o.o_custkey % 4 AS DOUBLE) AS delinq_2yrs, CAST(0 AS DOUBLE) AS out_prncp,
  CAST(0 AS DOUBLE) AS recoveries, CAST(o.o_custkey % 9 AS DOUBLE) AS num_actv_bc_tl,
  CASE WHEN o.o_custkey % 12 = 5 THEN NULL ELSE CAST(o.o_custkey % 2 AS DOUBLE) END
    AS pub_rec_bankruptcies,
  'N' AS debt_settlement_flag, 'CA' AS addr_state, '940xx' AS zip_code
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus <> 'P'
"""

STANDINS["rejected"] = """
SELECT o_totalprice / 10 AS amount_requested,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS application_date, o_orderpriority AS loan_title,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(500 + o_custkey % 300 AS DOUBLE) END AS risk_score,
  CASE WHEN o_orderkey % 40 = 3 THEN NULL
    ELSE CONCAT(CAST(o_orderkey % 90 AS STRING), '%') END AS dti,
  '940xx' AS zip_code, 'CA' AS state,
  CASE o_orderkey % 3 WHEN 0 THEN '< 1 year' WHEN 1 THEN '5 years' ELSE NULL END AS emp_length,
  CAST(0 AS DOUBLE) AS policy_code
FROM {orders} WHERE o_orderstatus = 'P'
"""

STANDINS["application"] = """
SELECT o.o_orderkey AS app_id, o.o_totalprice / 10 AS loan_amount,
  CAST(12 * (o.o_orderkey % 6) AS INT) AS loan_term,
  CASE o.o_custkey % 6 WHEN 0 THEN 'Registered Nurse' WHEN 1 THEN 'Software Engineer'
    WHEN 2 THEN 'Truck Driver' WHEN 3 THEN 'n/a' WHEN 4 THEN 'Financial Manager' ELSE '' END
    AS job_title,
  CASE o.o_orderkey % 6 WHEN 0 THEN '< 1 year' WHEN 1 THEN '10+ years' WHEN 2 THEN '3'
    WHEN 3 THEN 'N/A' WHEN 4 THEN '8 years' ELSE '2' END AS job_tenure,
  CASE c.c_mktsegment WHEN 'FURNITURE' THEN 'RENT' WHEN 'MACHINERY' THEN 'MORTGAGE'
    WHEN 'BUILDING' THEN 'OWN' WHEN 'AUTOMOBILE' THEN 'NONE' ELSE 'OTHER' END AS home_status,
  CASE WHEN c.c_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE c.c_acctbal * 12 END AS annual_income,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'car' WHEN 1 THEN 'debt consolidation' WHEN 2 THEN 'house'
    WHEN 3 THEN 'vacation' ELSE 'yacht' END AS loan_purpose,
  CASE WHEN o.o_orderkey % 19 = 4 THEN CAST(-1 AS DOUBLE) ELSE c.c_acctbal / 8 END AS monthly_debt,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN '2' ELSE 'maybe' END
    AS delinquencies,
  CAST(500 + o.o_custkey % 400 AS INT) AS credit_score,
  CAST(o.o_custkey % 15 AS INT) AS accounts,
  CASE WHEN o.o_orderkey % 10 = 1 THEN 'yes' ELSE 'no' END AS bankruptcy
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

STANDINS["call"] = """
SELECT conv_id, turn, conv_id * 1000 + turn AS call_id,
  CASE role WHEN 'system' THEN 'behavioural_features' WHEN 'user' THEN 'decisions'
    ELSE 'evaluation' END AS task,
  CASE WHEN conv_id % 2 = 0 THEN 'gpt-4o-mini' ELSE 'gpt-4o' END AS model,
  CASE WHEN turn % 3 = 2 THEN 0 ELSE LENGTH(text) END AS prompt_tokens,
  CASE WHEN turn % 3 = 2 THEN 0 ELSE LENGTH(role) END AS completion_tokens,
  CASE WHEN turn % 3 = 1 THEN NULL WHEN turn % 3 = 2 THEN LENGTH(text)
    ELSE LENGTH(text) + LENGTH(role) END AS total_tokens
FROM {conversations}
"""


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stand-in as a DataFrame over the parquet tables in ``sf_dir``."""
    sql = STANDINS[name]
    used = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{(\w+)}", sql))
    }
    return spark.sql(sql, **used)


def standin_sql(name: str) -> str:
    """The stand-in as a subquery over the registered views."""
    return "(" + re.sub(r"{(\w+)}", r"\1", STANDINS[name]).strip() + ")"


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stand-in as a table in the shared scratch folder, as loan history would be."""
    path = scratch_path(spark, name)
    standin(spark, sf_dir, name).write.parquet(path)
    return spark.read.parquet(path)
