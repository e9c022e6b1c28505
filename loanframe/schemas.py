"""Table layouts, in Spark's DDL notation."""

from __future__ import annotations

BANK = "date DATE, income DOUBLE, expense DOUBLE, balance DOUBLE, description STRING"
CARD = (
    "date DATE, business_name STRING, amount_of_deal DOUBLE, amount_paid DOUBLE, category STRING"
)
APPLICATION = (
    "loan_amount DOUBLE, loan_term INT, job_title STRING, job_tenure STRING, home_status STRING, "
    "annual_income DOUBLE, loan_purpose STRING, monthly_debt DOUBLE, delinquencies STRING, "
    "credit_score INT, accounts INT, bankruptcy STRING"
)
ACCEPTED = (
    "loan_amnt DOUBLE, issue_d STRING, title STRING, dti DOUBLE, emp_length STRING, "
    "policy_code DOUBLE, fico_range_high DOUBLE, term STRING, int_rate STRING, "
    "installment DOUBLE, grade STRING, sub_grade STRING, emp_title STRING, "
    "home_ownership STRING, annual_inc DOUBLE, loan_status STRING, purpose STRING, "
    "delinq_2yrs DOUBLE, out_prncp DOUBLE, recoveries DOUBLE, num_actv_bc_tl DOUBLE, "
    "pub_rec_bankruptcies DOUBLE, debt_settlement_flag STRING, addr_state STRING, zip_code STRING"
)
REJECTED = (
    "`Amount Requested` DOUBLE, `Application Date` STRING, `Loan Title` STRING, "
    "`Risk_Score` DOUBLE, `Debt-To-Income Ratio` STRING, `Zip Code` STRING, `State` STRING, "
    "`Employment Length` STRING, `Policy Code` DOUBLE"
)
LEDGER = (
    "timestamp TIMESTAMP, task STRING, prompt_tokens BIGINT, completion_tokens BIGINT, "
    "total_tokens BIGINT, cost_usd DOUBLE, cumulative_tokens BIGINT, total_cost_usd DOUBLE"
)

FEATURES = [
    "income_mean", "income_std", "expense_mean", "expense_std", "savings_rate_mean",
    "overdraft_frequency", "discretionary_share", "top_category_share", "category_volatility",
    "cc_payment_ratio_mean", "income_trend", "expense_trend", "savings_trend",
]
FLAGS = ["income_stability", "expense_volatility", "savings_habit", "category_concentration_risk"]

# The answers a credit application may give.
HOME_STATUS = ["RENT", "MORTGAGE", "OWN", "NONE"]
PURPOSES = [
    "car", "credit card", "debt consolidation", "education", "home improvement", "house",
    "major purchase", "medical", "moving", "other", "small business", "vacation", "wedding",
]
YES_NO = ["no", "yes"]
MAX_CREDIT_SCORE = 850
