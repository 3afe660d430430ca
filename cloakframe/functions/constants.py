"""Patterns, label sets and word lists.

Everything in this module is data that has to keep its exact value for results
to be right.  Patterns are written in the usual notation (``\\b`` is the ASCII
word boundary, ``\\s`` any Unicode space); :mod:`cloakframe.functions.patterns`
renders them for the JVM and for RE2.
"""

from __future__ import annotations

# --- fixed values: detector patterns -----------------------------------------
PATTERNS = {
    "UPI": r"(?i)\b[a-zA-Z0-9._\-]+@(?:upi|ybl|paytm|oksbi|okhdfcbank|okaxis|okicici|axl|ibl|sbi|hdfcbank|icici|kotak|apl|boi|cbin|cnrb|allbank|axisbank|freecharge|indianbank|indus|iob|jkb|kbl|kvb|mahb|pnb|rbl|sib|ubi|uboi|united|vijb|yes)\b",
    "EMAIL": r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b",
    "CARD": r"\b(?:\d{4}[\s\-]?){2,3}\d{1,4}(?:[\s\-]?\d{1,4})?\b",
    "BANK_ACCOUNT": r"\b\d{9,18}\b",
    "EPFO_UAN": r"\b\d{12}\b",
    "AADHAAR": r"\b[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}\b",
    "PAN": r"\b[a-zA-Z]{3}[PCGHFATBLJpcghfatblj][a-zA-Z]\d{4}[a-zA-Z]\b",
    "PHONE_IN": r"(?:(?:\+91[\s\-]?)|(?:0))?([6-9]\d{4}[\s\-]?\d{5})\b",
    "PHONE_INTL": r"\+(?!91\b)\d{1,3}[\s\-]?\d{6,14}\b",
    "IP": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "IFSC": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "DOB": r"\b(?:0[1-9]|[12]\d|3[01])[\/\-](?:0[1-9]|1[0-2])[\/\-](?:19|20)\d{2}\b",
    "PASSPORT": r"\b[A-Z]\d{7}\b",
    "OTP": r"\b\d{4,8}\b",
    "VOTER_ID": r"\b[A-Z]{3}[\s\/-]?\d{7}\b",
    "DL": r"\b[A-Z]{2}[-\s]?[0-9]{2}[-\s]?(?:19|20)[0-9]{2}[-\s]?[0-9]{7}\b|\b[A-Z]{2}[0-9]{13}\b",
    "VEHICLE_RC": r"\b[A-Z]{2}[-\s]?[0-9]{1,2}[-\s]?[A-Z]{1,3}[-\s]?[0-9]{4}\b|\b[0-9]{2}[-\s]?BH[-\s]?[0-9]{4}[-\s]?[A-Z]{1,2}\b",
}

# --- fixed values: exclusion and context sets --------------------------------
UPI_PROVIDERS = [
    "upi", "ybl", "paytm", "oksbi", "okhdfcbank", "okaxis", "okicici",
    "axl", "ibl", "sbi", "hdfcbank", "icici", "kotak", "apl", "boi",
    "cbin", "cnrb", "allbank", "axisbank", "freecharge", "indianbank",
    "indus", "iob", "jkb", "kbl", "kvb", "mahb", "pnb", "rbl", "sib",
    "ubi", "uboi", "united", "vijb", "yes",
]
SYSTEM_MAILBOXES = [
    "noreply", "no-reply", "no_reply", "support", "help", "helpdesk",
    "info", "information", "admin", "administrator", "webmaster", "postmaster",
    "contact", "contactus", "contact-us", "feedback", "suggestions",
    "sales", "marketing", "team", "hello", "hi",
    "newsletter", "notifications", "alerts", "mailer-daemon", "daemon",
    "donotreply", "do-not-reply", "do_not_reply",
    "privacy", "security", "abuse", "legal", "compliance",
    "billing", "invoice", "accounts", "service", "services", "system",
    "recruitment", "hr", "careers", "jobs",
]
LABELS = {
    "support_phone": [
        "helpline", "customer care", "toll free", "toll-free", "tollfree",
        "call us", "contact us", "reach us", "dial", "enquiry", "enquiries",
        "customer service", "customer support", "grievance",
    ],
    "dob": [
        "dob", "date of birth", "birthday", "birth date", "birthdate",
        "born on", "born", "d.o.b", "d.o.b.",
    ],
    "passport": [
        "passport", "passport number", "passport no", "passport #",
        "travel document", "passport id",
    ],
    "otp": [
        "otp", "verification code", "verify", "one-time password", "security code",
        "passcode", "verification", "auth code", "enter code", "your code",
    ],
    "dl": [
        "dl", "driving license", "driving licence", "d/l", "licence no",
        "license no", "dl no", "driver license",
    ],
    "uan": [
        "uan", "universal account number", "epfo", "pf number", "pf no",
        "provident fund", "member id",
    ],
    "vehicle": [
        "vehicle", "rc", "registration", "reg no", "plate", "car no", "bike no",
        "chassis", "motor", "vehicle no",
    ],
    "bank": [
        "account number", "account no", "a/c no", "a/c number", "ac no",
        "bank account", "saving account", "savings account", "current account",
        "a/c #", "acct no", "account #", "bank a/c",
    ],
}
STATE_CODES = [
    "AN", "AP", "AR", "AS", "BR", "CG", "CH", "DD", "DN", "DL",
    "GA", "GJ", "HR", "HP", "JH", "JK", "KA", "KL", "LA", "LD",
    "MP", "MH", "MN", "ML", "MZ", "NL", "OD", "OR", "PB", "PY",
    "RJ", "SK", "TN", "TS", "TR", "UP", "UK", "UA", "WB",
]
HARMLESS_IPS = [
    "0.0.0.0", "127.0.0.1", "255.255.255.0", "255.255.255.255",
    "192.168.0.1", "192.168.1.1", "10.0.0.1", "10.0.0.0",
    "172.16.0.0", "224.0.0.0", "169.254.0.0",
]
NON_PERSONAL_AREAS = [
    "footer", "nav", "header", "privacy-policy", "terms", "legal", "tos",
    "cookie-banner", "cookie-consent", "sitemap",
]
HIDDEN_VALUE = "[hidden]"
PASSWORD_TOKEN = "[PASSWORD_FIELD]"
AVATAR_VALUE = "[USER_AVATAR]"

# --- fixed values: attribute rule patterns -----------------------------------
ATTRIBUTE_PATTERNS = {
    "card_label": r"(?i)(?:addcreditcardnumber|card[-_\s]?number|credit[-_\s]?card)",
    "holder_label": r"(?i)(?:cardholder|nickname|name\s*on\s*card|account\s*holder)",
    "address_label": r"(?i)(?:deliver(?:ing)? to|shipping address|delivery address|home address)",
    "address_text": r"(?i)(?:flat|building|path|chs|bazar|road|street|nagar|sector|\b\d{6}\b)",
    "account_nav": r"(?i)(?:nav[-_]?link[-_]?account|user[-_]?profile|account[-_]?list)",
    "greeting": r"(?i)\b(?:hello|hi|welcome)[,\s]+([a-zA-Z]{2,})",
    "avatar": r"(?i)(?:avatar|profile[-_]?image|profile[-_]?photo|profile[-_]?pic|user[-_]?avatar|account[-_]?avatar)",
    "avatar_img": r"(?i)(?:avatar|profile|user)",
    "name_label": r"(?i)(?:first[-_\s]?name|last[-_\s]?name|full[-_\s]?name|given[-_\s]?name|family[-_\s]?name|instructor|faculty)",
    "name_value": r"^[a-zA-Z\s.'-]{2,40}\z",
    "bank_label": r"(?i)(?:account[-_\s]?num|a\/c[-_\s]?no|acct[-_\s]?no|bank[-_\s]?acc)",
    "dl_label": r"(?i)(?:driving[-_\s]?licen|dl[-_\s]?no|license[-_\s]?no)",
    "voter_label": r"(?i)(?:voter[-_\s]?id|epic[-_\s]?no|election[-_\s]?card)",
    "uan_label": r"(?i)(?:epfo|uan[-_\s]?no|pf[-_\s]?number|provident[-_\s]?fund)",
    "vehicle_label": r"(?i)(?:vehicle[-_\s]?reg|rc[-_\s]?no|registration[-_\s]?no|plate[-_\s]?no)",
}

# --- fixed values: severity tiers and report buckets -------------------------
TIERS = {
    "SPII": ["AADHAAR", "PAN", "CARD", "PASSWORD_FIELD", "OTP", "VOTER_ID", "DL",
             "EPFO_UAN", "BANK_ACCOUNT"],
    "PII": ["EMAIL", "PHONE", "NAME", "UPI", "AVATAR", "VEHICLE_RC"],
}
BREAKDOWN_BUCKETS = {
    "EMAIL": "emails", "PHONE": "phones", "NAME": "names", "ADDRESS": "addresses",
    "AADHAAR": "aadhaar", "PAN": "pan", "CARD": "cards", "DOB": "dob", "UPI": "upi",
    "VOTER_ID": "voter_id", "DL": "dl", "EPFO_UAN": "uan",
    "BANK_ACCOUNT": "bank_account", "VEHICLE_RC": "vehicle_rc",
}
DETECTION_METHODS = ["REGEX", "NER", "OCR_REGEX", "OCR_NER", "DOM_ATTRIBUTE"]
VAULT_FLAGS = ["email", "password", "phone", "card", "aadhaar", "pan"]
PII_TYPES = [
    "EMAIL", "PHONE", "AADHAAR", "PAN", "CARD", "DOB", "IP", "UPI", "IFSC",
    "PASSPORT", "PASSWORD_FIELD", "OTP", "NAME", "ADDRESS", "AVATAR", "SSN",
    "VOTER_ID", "DL", "EPFO_UAN", "VEHICLE_RC", "BANK_ACCOUNT",
]

# --- fixed values: named-entity post-processing ------------------------------
NER_CHUNK_WORDS = 307
NER_CHUNK_STRIDE = 257
NER_TYPES = {"PER": "NAME", "LOC": "ADDRESS", "ORG": "ORGANIZATION"}
NER_BRANDS = [
    "amazon", "flipkart", "google", "apple", "microsoft", "samsung", "sony",
    "dell", "hp", "lenovo", "asus", "acer", "nokia", "motorola", "xiaomi",
    "oneplus", "oppo", "vivo", "realme", "poco", "redmi", "huawei",
    "meta", "facebook", "instagram", "whatsapp", "twitter", "linkedin",
    "youtube", "netflix", "spotify", "adobe", "oracle", "ibm", "intel",
    "nvidia", "amd", "qualcomm", "uber", "ola", "zomato", "swiggy",
    "paytm", "phonepe", "razorpay", "hdfc", "icici", "sbi", "axis",
    "kotak", "bajaj", "reliance", "jio", "airtel", "vodafone", "tata",
    "infosys", "wipro", "hcl", "mahindra", "byju", "unacademy",
    "boat", "jbl", "bose", "sennheiser", "skullcandy", "zebronics",
    "nike", "adidas", "puma", "reebok", "levi", "zara", "h&m",
    "home", "about", "login", "signup", "cart", "checkout", "profile",
    "settings", "search", "menu", "help", "contact", "privacy",
]
NER_STOP_NAMES = [
    "the", "mr", "mrs", "ms", "dr", "sir", "no", "yes", "new", "old", "buy",
    "sell", "add", "get", "top", "best", "free",
]
NER_GENERIC_PLACES = ["india", "usa", "uk", "us"]
NER_PERSON_CONTEXT = [
    "profile", "account", "user", "greeting", "welcome",
    "form", "input", "address", "shipping", "billing",
    "review-author", "reviewer", "author",
    "my-account", "my-profile", "dashboard",
    "recipient", "sender", "contact",
]
NER_ADDRESS_CONTEXT = [
    "address", "delivery", "shipping", "billing",
    "profile", "residence", "home-address", "office-address",
    "pickup", "dropoff", "destination", "form", "input",
]
NER_PUBLIC_PLACE_CONTEXT = [
    "filter", "navigation", "breadcrumb", "nav",
    "search-result", "search", "store-locator",
    "footer", "header", "menu", "sidebar",
    "city-selector", "location-picker", "pin-code",
]
NER_EMPLOYER_CONTEXT = ["employer", "company", "workplace", "organization"]

# --- fixed values: risk levels -----------------------------------------------
CRITICAL_ACTIONS = ["TYPE_FROM_VAULT", "CAPTCHA_HANDOFF"]
CRITICAL_WORDS = [
    "purchase", "buy", "checkout", "payment", "pay", "order", "cart",
    "credit card", "debit card", "upi", "net banking", "wallet",
    "refund", "transfer", "send money", "withdraw", "deposit",
    "login", "log in", "signin", "sign in", "authenticate", "otp",
    "verify identity", "two-factor", "2fa",
    "delete", "remove", "cancel account", "deactivate", "unsubscribe",
    "wipe", "erase", "purge",
    "password", "secret", "private", "confidential", "ssn", "aadhaar",
    "pan card", "bank account",
]
CAUTION_WORDS = [
    "form", "fill", "submit", "filter", "select", "choose",
    "change", "update", "modify", "edit", "rename", "move",
    "enable", "disable", "toggle", "switch",
    "redirect", "navigate", "forward", "back",
]
SAFE_WORDS = [
    "read", "view", "check", "verify", "inspect", "browse",
    "scroll", "hover", "highlight", "focus",
]
REASON_WORDS = ["purchase", "buy", "checkout", "payment", "login", "delete", "transfer"]
REASONS = {
    "vault": "Vault data access requires explicit user permission",
    "captcha": "CAPTCHA must be solved by the user manually",
    "critical": "Sensitive operation requiring user approval",
    "forbidden": "This action is not permitted",
    "caution": "Action modifies page state — user should be aware",
    "safe": "Safe autonomous action",
}

# --- fixed values: screen types, in order of precedence -----------------------
SCREEN_WORDS = {
    "login_auth": ["login", "username", "password", "sign in", "sign up", "eduplus", "tpo"],
    "email_inbox": ["gmail", "inbox", "verification code", "otp", "subject", "reply"],
    "account_settings": ["account chooser", "google account", "choose an account", "manage account"],
    "checkout_cart": ["checkout", "credit card", "payment method", "delivering to", "card number"],
    "search_results": ["amazon", "search", "deliver to", "deals", "cart", "shop"],
}
DEFAULT_SCREEN = "general_webpage"

# --- fixed values: protocol messages and step states --------------------------
MESSAGE_TYPES = [
    "USER_QUERY", "STEP_RESULT", "APPROVAL_RESPONSE", "SESSION_RESTORE",
    "PAUSE_AGENT", "RESUME_AGENT", "STOP_AGENT", "PLAN", "NEXT_STEP",
    "APPROVAL_REQUIRED", "DYNAMIC_OBSTACLE", "SESSION_RESTORED",
    "TASK_COMPLETE", "ERROR",
]
MESSAGE_ROUTES = {
    "USER_QUERY": "user_query",
    "STEP_RESULT": "step_result",
    "APPROVAL_RESPONSE": "approval_response",
    "SESSION_RESTORE": "session_restore",
    "PAUSE_AGENT": "pause_agent",
    "RESUME_AGENT": "resume_agent",
    "STOP_AGENT": "stop_agent",
}
ACTIONS = [
    "NAVIGATE", "CLICK", "TYPE", "TYPE_FROM_VAULT", "PRESS_KEY", "HOVER", "SCROLL",
    "SELECT", "WAIT", "SCREENSHOT", "EXTRACT", "NEW_TAB", "SWITCH_TAB", "CLOSE_TAB",
    "DISMISS_POPUP", "CAPTCHA_HANDOFF", "REPORT_RESULT",
]
MAX_RETRIES = 2
STEP_TRANSITIONS = {
    "PENDING": ["RUNNING", "CANCELLED", "SKIPPED", "BLOCKED_APPROVAL"],
    "RUNNING": ["SUCCESS", "FAILED", "BLOCKED_APPROVAL"],
    "SUCCESS": [],
    "FAILED": ["RETRYING", "HYBRID_FALLBACK", "CANCELLED"],
    "BLOCKED_APPROVAL": ["RUNNING", "CANCELLED"],
    "RETRYING": ["RUNNING", "FAILED", "HYBRID_FALLBACK"],
    "HYBRID_FALLBACK": ["RUNNING", "SUCCESS", "FAILED"],
    "SKIPPED": [],
    "CANCELLED": [],
}
TERMINAL_STATES = ["SUCCESS", "SKIPPED", "CANCELLED"]
