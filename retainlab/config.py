"""Fixed values that must equal the modelled application for equal results.

Everything here is stated plainly, as text, in natural order.
"""

# --- fixed values: business costs -------------------------------------------
COST_FN = 500.0          # cost of a missed churner
COST_FP = 50.0           # cost of a wasted retention offer
DEFAULT_THRESHOLD = 0.5

# --- fixed values: risk tiers (right-closed: [0,0.3] (0.3,0.6] (0.6,1]) -----
TIER_EDGES = (0.3, 0.6)
TIERS = ("low", "medium", "high")

# --- fixed values: recommendation texts by risk level (left-closed) --------
RECOMMENDATION_LOW = "No action needed. Monitor quarterly."
RECOMMENDATION_MEDIUM = "Send proactive retention email with loyalty discount (5-10%)."
RECOMMENDATION_HIGH = "Escalate to account manager. Offer contract upgrade or significant discount."

# --- fixed values: expected remaining lifetime in months by contract -------
LIFETIME_MONTHS = {"Month-to-month": 6, "One year": 18, "Two year": 30}
LIFETIME_DEFAULT = 12

# --- fixed values: the six service columns counted by NumServices ----------
SERVICE_COLUMNS = (
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
)

# --- fixed values: tenure bins, right-closed, 0 falls outside --------------
TENURE_BINS = ((0, 12, "0-12"), (12, 24, "13-24"), (24, 48, "25-48"), (48, 72, "49-72"))
TENURE_OPEN_LABEL = "73+"

# --- fixed values: customer table columns in source order ------------------
ID_COL = "customerID"
TARGET_COL = "Churn"
FEATURE_COLUMNS = (
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "tenure",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
    "MonthlyCharges",
    "TotalCharges",
)

# --- fixed values: interventions (action, category, priority, cost, text) --
INTERVENTION_CONTRACT = (
    "Upgrade to 1-year contract",
    "Contract",
    "high",
    0.0,
    "Month-to-month customers churn 3x more. Offer a 1-year contract with a loyalty discount.",
)
INTERVENTION_SUPPORT = (
    "Add free Tech Support (3 months)",
    "Service",
    "medium",
    30.0,
    "Tech support is a top churn reducer. Offer 3 months free trial.",
)
INTERVENTION_SECURITY = (
    "Add Online Security bundle",
    "Service",
    "medium",
    20.0,
    "Customers with online security have significantly lower churn rates.",
)
INTERVENTION_AUTOPAY = (
    "Switch to automatic payment",
    "Billing",
    "low",
    0.0,
    "Electronic check users churn 2x more. Incentivize auto-pay enrollment.",
)
INTERVENTION_DISCOUNT_ACTION = "Offer 10-15% loyalty discount"
INTERVENTION_DISCOUNT_CATEGORY = "Pricing"
INTERVENTION_DISCOUNT_SHARE = 0.12
INTERVENTION_DISCOUNT_MIN_CHARGE = 80.0
INTERVENTION_DISCOUNT_HIGH_P = 0.6
INTERVENTION_DISCOUNT_TEXT = "Monthly charges (${}) are above average. A discount may retain this customer."

# --- fixed values: watch-list quick actions --------------------------------
QUICK_ACTIONS = ("Contract upgrade", "Add tech support", "Switch to auto-pay")

# --- fixed values: executive priority actions ------------------------------
PRIORITY_ACTIONS = (
    (1, "Target month-to-month high-risk customers for contract upgrades", "Contract"),
    (2, "Offer free tech support trial to at-risk internet customers", "Service"),
    (3, "Incentivize auto-pay enrollment for electronic check users", "Billing"),
)
