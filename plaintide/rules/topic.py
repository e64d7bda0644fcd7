"""Topic rules: weighted keywords per business topic."""

# Fixed values. "*" marks a word prefix, "|n" an explicit weight; without it a term weighs as many
# points as it has words. The order of the topics decides ties.
TOPIC_KEYWORDS = {
    "Delivery": [
        "deliver*", "shipping", "shipped", "shipment", "courier", "parcel*", "package*", "tracking",
        "arrived", "arrive", "arrival", "late", "delayed", "delay", "transit", "dispatch*", "pickup",
        "pick up", "not received|3", "never received", "haven't received|3", "hasn't arrived|2",
        "left it at", "order confirmation|0",
    ],
    "Customer Support": [
        "support|2", "customer service|3", "customer care|3", "agent*|2", "representative*",
        "helpline", "respond*", "response", "reply", "replied", "escalat*", "staff", "rude", "polite",
        "courteous", "on hold", "transferred|2", "no resolution|2", "resolve*", "explain my issue|3",
        "contacting", "follow-ups",
    ],
    "Product Quality": [
        "quality|2", "defect*|2", "broken", "broke", "damaged", "not working", "stopped working",
        "stopped functioning|2", "malfunction*", "faulty", "cheap", "flimsy|2", "material*", "build|2",
        "worn", "wear", "peeling", "cracked", "torn", "sturdy|2", "well made|2", "durable|2", "finish",
        "scratch*", "scuff*|2", "crushed", "premium|2", "solid|2", "holding up|3", "as advertised|2",
        "matches the description|3", "feels|1",
    ],
    "Refund": [
        "refund*|3", "return|2", "returns|2", "returned|2", "money back|3", "reimburse*|3", "exchange",
        "return label|3", "sent back|2",
    ],
    "Payment": [
        "payment|2", "charged|2", "charge", "charges", "billing|2", "billed|2", "invoice|2",
        "transaction", "deducted|3", "amount", "double charged|4", "charged twice|4", "gateway|2",
        "card", "receipt", "overcharged|3", "upi", "emi", "bill|2", "checkout|1",
        "confirmation email|2", "confirmation|1",
    ],
    "Pricing": [
        "price", "prices", "expensive", "costly", "overpriced", "value for money", "affordable",
        "discount*", "coupon*", "promo*", "deal", "cost", "worth", "rupee*", "budget", "pricing",
    ],
    "Website/App": [
        "app|2", "apps|2", "website|2", "site", "page", "loading", "loads", "crash*|2", "error", "bug",
        "glitch*", "interface", "navigation", "search", "checkout", "laggy|2", "timed out|2",
        "notifications", "not loading", "slow website",
    ],
    "Product Features": [
        "feature*", "functionality", "option", "setting*", "button", "missing feature", "wish it had",
        "should have", "lacks", "lacking", "no option", "specification*", "colour", "color", "size",
        "variant",
    ],
    "Account": [
        "account|2", "login|2", "log in|2", "sign in|2", "sign up", "password|2", "reset", "otp|2",
        "verify", "verification", "profile", "username", "registered", "registration", "log out",
        "locked|2",
    ],
}

# Column names that may hold a curated category, best first.
CATEGORY_NAMES = [
    "feedback_category", "category", "topic", "issue_category", "complaint_category", "department",
    "type", "feedback_type", "tag", "theme",
]
