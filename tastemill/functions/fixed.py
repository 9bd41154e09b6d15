"""They must be exactly these for the results to be right."""

# Merchandise departments left out of every customer sales figure.
EXCLUDED_DEPARTMENTS = (
    428, 431, 432, 441, 604, 836, 838, 904, 937, 965, 995, 822, 833, 840, 901,
)

# Division sold as flash sales, and the pair left out of shopping-gap features.
FLASH_DIVISION = (27,)
GAP_EXCLUDED_DIVISIONS = (27, 77)

# Beauty division left out of designer profiles.
BEAUTY_DIVISION = 53

# Positions (from 1) in the suppression bit string that exclude a customer.
SUPPRESSION_POSITIONS = (1, 3, 5, 6, 7, 42)

# Item codes start with this; part of the click and register line filters.
ITEM_PREFIX = "NM"

# Words that exclude an item by its description, any case.
EXCLUDED_DESCRIPTION_WORDS = (
    "swim", "christmas", "ornament", "trunk show", "unknown brand", "unclassified",
    "gwp", "ingestibles", "desserts", "hardware", "misc",
)

# Division names and the group that never enter ratings.
EXCLUDED_DIVISION_NAMES = (
    "Last Call Direct Purchase",
    "Flash Sales Direct Purchase",
    "NMG Miscellaneous",
    "Intimate Apparel",
    "Non Retail",
)
EXCLUDED_GROUP = "818"

# Regular expressions that exclude a brand and class from recommendations.
EXCLUDED_BRAND_CLASS = (
    "UNKNOWN BRAND", "Trunk Show", "Swimsuit", "Swim", "Unclassified", "GWP", "Bow Ties",
    "Napkins", "Travel", "Ingestibles", "Socks", "Desserts", "Gentlemen?s", "Hardware",
    "Louis Vuitton", "Christmas",
)

# Division name prefix -> short name; the first that fits counts.
DIVISION_SHORT_NAMES = (
    ("Wo", "WA"), ("Co", "CA"), ("Ch", "Ch"), ("Gi", "GH"), ("La", "LS"), ("De", "DH"),
    ("Fa", "FA"), ("Me", "Men"), ("Be", "Be"), ("Je", "Je"), ("Fi", "FA"), ("No", "NR"),
    ("In", "IA"), ("NMG Mis", "Mis"),
)

# Gender prefix -> code; anything else is "N".
GENDER_CODES = ("W", "U", "M", "G", "B")

# Location attributes -> chain code, first rule that fits counts.
CHAIN_RULES = (
    ("chain_id", (4,), "LC"),
    ("district_id", (13012, 13022), "HC"),
    ("district_id", (12031,), "CU"),
    ("chain_id", (2,), "BG"),
    ("district_id", (13013,), "BG"),
    ("district_id", (13011, 13021, 13014), "NM"),
    ("area_id", (14,), "NM"),
    ("region_id", (201,), "NM"),
)

# Locations whose register lines count as daily revenue: any of the three fits.
REVENUE_AREAS = (14,)
REVENUE_REGIONS = (201,)
REVENUE_DISTRICTS = (13011, 13021, 13014)

# Weights of a purchase and a browse in the implicit rank; quantiles of the score.
PURCHASE_WEIGHT = 0.8
BROWSE_WEIGHT = 0.2
TASTE_QUANTILES = (0.25, 0.5, 0.75, 0.85)

# Loyalty account types, placeholder e-mails and the owner code left out.
LOYALTY_TENDER_TYPES = ("BG", "CHG")
PLACEHOLDER_EMAILS = ("None", "none@capitalone-no-email.com")
EXCLUDED_EMAIL_OWNER = "AM"

# Location that stands for web-only stock.
WEB_STOCK_LOCATION = 124

# Spend over twelve months that makes a customer a high spender.
HIGH_SPEND = 500_000

# Source that marks very important customers, and the status of customers abroad.
VIP_SOURCE = "DLE"
ABROAD = "International"

# Columns of the customer, metric, relationship and associate results.
PROFILE_COLUMNS = ["cust_id", "prefix", "first_name", "middle_initial", "last_name"]
METRICS_COLUMNS = [*PROFILE_COLUMNS, "level", "alive_probability", "predicted_purchases", "clv_frequency", "clv_recency",
                   "clv_monetary_value", "cf_segment", "cf_customer_status"]
RELATION_COLUMNS = ["cust_id", "assoc_id", "l24m_trips", "relationship_l24m", "net_spent_l24m"]
ASSOCIATE_COLUMNS = ["associate_pin", "assoc_id", "first_name", "last_name", "location_id", "age_days",
                     "revenue_l12m", "transactions_l12m", "customers_l12m"]
