"""Rule tables: word lists, patterns, weights and bands.

Everything in this module is a fixed value of the scoring method and has to
stay exactly as it is for scores to be comparable. Lists are in their natural
order; where order matters (first match wins, ties) the list index is the rank.
"""

# --- fixed values: link rules -------------------------------------------------
URL_SHORTENERS = [
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly",
    "adf.ly", "j.mp", "tr.im", "tiny.cc", "cutt.ly", "rebrand.ly", "short.io",
]
URL_TRUSTED = [
    "google.com", "microsoft.com", "apple.com", "amazon.com", "facebook.com",
    "twitter.com", "linkedin.com", "instagram.com", "youtube.com",
    "netflix.com", "spotify.com", "twitch.tv", "github.com",
    "stackoverflow.com", "wikipedia.org", "reddit.com", "paypal.com",
    "ebay.com", "walmart.com", "target.com", "chase.com",
    "bankofamerica.com", "wellsfargo.com",
]
SUSPICIOUS_TLDS = ["tk", "ga", "cf", "ml", "gq", "xyz", "top", "club"]
DOMAIN_KEYWORDS = ["secure", "login", "account", "verify", "bank", "paypal", "signin"]
PATH_PATTERNS = [
    ("repeated slashes", r"//+"),
    ("directory traversal", r"/\.\./+"),
    ("very long segment", r"/[^/]{50}"),
    ("hidden extension", r"\.(php|asp|aspx|jsp)\."),
    ("invalid characters", r"[<>\"]"),
]
REDIRECT_PARAMS = ["redir", "redirect", "url", "link", "goto", "return"]
REDIRECT_TARGET_PATTERNS = [
    r"/[^/]+\.php\?[^/]+=[^/]+",
    r"/(?:login|signin|account)/.*redirect",
    r"/(?:go|click|track)\.php",
    r"/[^/]+\.cgi\?",
    r"/(?:redir|redirect|forward)\.aspx",
]
MAX_REDIRECTS = 5
DEFAULT_PORTS = {"http": 80, "https": 443}

# --- fixed values: the light scorer -------------------------------------------
LITE_BRANDS = ["paypal", "apple", "microsoft", "google", "amazon", "facebook", "netflix"]
LITE_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz"]
LITE_WEIGHTS = {"sender": 0.4, "url": 0.4, "content": 0.2}
BUSINESS_TERMS = [
    "order", "invoice", "delivery", "shipping", "tracking", "purchase",
    "transaction", "receipt", "account", "service",
]
URGENT_TERMS = [
    "urgent action", "immediate action", "account suspended",
    "unauthorized access", "security breach", "suspicious activity",
    "account terminated", "legal action", "lawsuit", "police",
]
THREAT_PATTERNS = [
    "account.*(?:blocked|suspended|terminated)",
    "unauthorized.*(?:access|transaction|change)",
    "security.*(?:breach|compromise|incident)",
    "legal.*(?:action|consequence|measure)",
    "criminal.*(?:charge|prosecution|investigation)",
]

# --- fixed values: sender rules -------------------------------------------------
SENDER_TRUSTED = [
    "gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com",
    "microsoft.com", "apple.com", "amazon.com", "facebook.com", "twitter.com",
    "linkedin.com", "netflix.com", "spotify.com", "twitch.tv", "youtube.com",
    "discord.com", "steam.com", "steamcommunity.com", "steampowered.com",
    "paypal.com", "chase.com", "bankofamerica.com", "wellsfargo.com",
]
SENDER_WEIGHTS = {
    "domain_age": 0.15, "domain_reputation": 0.25, "typosquatting": 0.2,
    "spf": 0.1, "dmarc": 0.1, "dkim": 0.1, "domain_alignment": 0.1,
}
SPF_MECHANISMS = [
    "all", "include", "a", "mx", "ptr", "ip4", "ip6", "exists", "redirect", "exp",
]
KNOWN_SENDER_DOMAINS = [
    "cursor.so", "github.com", "google.com", "microsoft.com", "apple.com",
    "twitch.tv", "twitter.com", "linkedin.com",
]
FREE_MAIL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com"]
# exact domain -> category, then substring -> category; first hit wins
SENDER_CATEGORY_EXACT = [
    ("cursor.so", "developer_tool"),
    ("github.com", "development_platform"),
    ("twitch.tv", "streaming_platform"),
]
SENDER_CATEGORY_PART = [
    ("google", "tech_company"), ("microsoft", "tech_company"),
    ("apple", "tech_company"), ("linkedin", "social_network"),
    ("twitter", "social_network"),
]
MAIL_TYPES = [
    ("security_related", ["password", "security", "login"]),
    ("financial", ["invoice", "payment", "bill"]),
    ("informational", ["update", "news", "newsletter"]),
    ("onboarding", ["welcome", "getting started"]),
    ("verification", ["verify", "confirm"]),
]

# --- fixed values: behaviour rules ----------------------------------------------
BEHAVIOR_WEIGHTS = {
    "sending_time": 0.2, "geographic_origin": 0.3,
    "sender_history": 0.3, "header_consistency": 0.2,
}
HIGH_RISK_COUNTRIES = ["Russia", "China", "Nigeria", "North Korea", "Iran"]

# --- fixed values: indicator bank (matched without regard to case) --------------
INDICATORS = {
    "phishing": ("Contains phishing phrase", [
        r"verify your account",
        r"confirm your (?:identity|account|password)",
        r"your account (?:has been|will be) (?:suspended|limited|restricted)",
        r"unusual activity",
        r"security alert",
        r"click (?:here|the link|below) to (?:verify|confirm)",
        r"limited access",
        r"urgent action required",
        r"failure to (?:verify|confirm|respond)",
        r"your account will be (?:terminated|suspended|closed)",
        r"update (?:your|payment|billing) (?:information|details|method)",
        r"we were unable to process your (?:payment|transaction)",
        r"you have won",
        r"congratulations",
        r"claim your (?:prize|reward|gift)",
        r"suspicious (?:login|activity|sign-in)",
        r"security breach",
        r"unauthorized access",
        r"restore (?:access|account)",
        r"secure your account",
        r"we detected",
        r"we have detected",
        r"we noticed",
        r"immediate(?:ly)? (?:verify|confirm|update)",
        r"account (?:compromised|hacked|at risk)",
        r"personal (?:details|information) (?:required|needed)",
        r"validate your (?:account|information)",
    ]),
    "urgency": ("Creates urgency", [
        r"immediate(?:ly)?",
        r"urgent(?:ly)?",
        r"within 24 hours",
        r"within 48 hours",
        r"as soon as possible",
        r"failure to comply",
        r"will result in",
        r"account (?:suspension|termination)",
        r"time(?:-|\s)?sensitive",
        r"expires (?:soon|today|tomorrow)",
        r"limited time",
        r"act now",
        r"immediate attention",
        r"promptly",
        r"without delay",
        r"deadline",
        r"last chance",
        r"final notice",
        r"warning",
    ]),
    "request": ("Suspicious request", [
        r"(?:update|confirm) your (?:personal|account) (?:information|details)",
        r"(?:enter|provide|verify) your (?:password|credentials)",
        r"click (?:the|this) link",
        r"download (?:the|this) attachment",
        r"reply with your",
        r"send (?:us|back) your",
        r"fill (?:out|in) the form",
        r"login to your account",
        r"sign in to your account",
        r"verify your identity",
        r"update your payment method",
        r"confirm your billing information",
        r"update your credit card",
        r"provide your (?:social security|tax) number",
        r"enter your (?:PIN|CVV|security code)",
        r"submit your information",
    ]),
    "phrasing": ("Poor grammar/phrasing", [
        r"\b(?:i|we) (?:is|are|was|were) going\b",
        r"\byou (?:is|am|was) going\b",
        r"\bthey is\b",
        r"\bhe are\b",
        r"\bshe are\b",
        r"\bkindly\b.*\b(?:do|proceed|provide|verify)\b",
        r"\brespond back\b",
        r"\brevert back\b",
        r"\bdear (?:valued|esteemed) customer\b",
        r"\bdear user\b",
        r"\bhello (?:customer|user|client|member)\b",
    ]),
    "threat": ("Contains threat", [
        r"will be (?:suspended|terminated|closed|locked|blocked)",
        r"will (?:lose|restrict) access",
        r"account will be (?:closed|suspended)",
        r"service will be (?:interrupted|suspended|terminated)",
        r"failure to",
        r"if you (?:fail|don't|do not) (?:respond|reply|verify|confirm|update)",
        r"avoid (?:suspension|termination|interruption)",
        r"prevent (?:suspension|termination|interruption)",
        r"or (?:else|otherwise)",
    ]),
}
# one indicator per match; `plain_host` leaves out hosts that start with www.
INDICATOR_URL_PATTERNS = {
    "plain_host": r"http://[a-z0-9-]+\.[a-z]{2,}",
    "ip_host": r"https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "cheap_tld": r"https?://.*?\.(?:tk|ga|cf|ml|gq|xyz|top|club)\b",
    "lure_subdomain":
        r"https?://.*?(?:secure|login|account|verify|confirm|update|banking)\.[a-z0-9-]+\.[a-z]{2,}",
    "lure_label":
        r"https?://.*?(?:verify|confirm|secure|login|account|update|auth|banking)(?:-|_)[a-z0-9-]+\.[a-z]{2,}",
}
HIGH_RISK_WORDS = ["suspicious url", "verify", "urgent", "account", "password", "click", "threat"]

# --- fixed values: hand features, element keywords, image text ------------------
SUSPICIOUS_TOKENS = [
    "urgent", "verify", "account", "login", "password", "click", "confirm",
    "update", "suspend", "bank", "security", "alert", "immediately", "restricted",
]
ELEMENT_KEYWORDS = [
    "urgent", "verify", "account", "login", "password", "click", "confirm",
    "update", "suspend",
]
ELEMENT_URL_KEYWORDS = ["secure", "login", "account", "verify"]
IMAGE_BRANDS = [
    "paypal", "apple", "microsoft", "amazon", "google", "facebook",
    "instagram", "twitter", "netflix", "bank of america", "chase",
    "wells fargo", "citibank", "linkedin", "dropbox", "gmail",
    "outlook", "office365", "yahoo", "spotify", "steam", "discord",
]
IMPERSONATION_BRANDS = [
    ("PayPal", "paypal", "paypal.com"), ("Apple", "apple", "apple.com"),
    ("Microsoft", "microsoft", "microsoft.com"), ("Amazon", "amazon", "amazon.com"),
    ("Google", "google", "google.com"), ("Facebook", "facebook", "facebook.com"),
    ("Instagram", "instagram", "instagram.com"), ("Twitter", "twitter", "twitter.com"),
    ("Netflix", "netflix", "netflix.com"),
    ("Bank of America", "bankofamerica", "bankofamerica.com"),
    ("Chase Bank", "chase", "chase.com"),
]
TYPO_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-_"
LOOKALIKES = {
    "a": ["4", "@"], "e": ["3"], "i": ["1", "!"], "o": ["0"], "s": ["5", "$"],
    "l": ["1"], "b": ["8"], "t": ["7"], "g": ["9"], "z": ["2"],
}

# --- fixed values: ensemble ------------------------------------------------------
ENSEMBLE_WEIGHTS = {
    "sender": 0.25, "image": 0.15, "behavioral": 0.2,
    "url": 0.25, "llm": 0.1, "vector_similarity": 0.05,
}
ENSEMBLE_CONFIG_WEIGHTS = {
    "sender": 0.25, "image": 0.05, "behavioral": 0.2,
    "url": 0.25, "llm": 0.2, "vector_similarity": 0.05,
}
FAILED_COMPONENT_SCORES = {"sender": 0.5, "url": 0.5, "behavioral": 0.5, "image": 0.0}
CONFIDENCE_THRESHOLD = 0.5
HIGH_CONFIDENCE_THRESHOLD = 0.8
BORDERLINE_WIDTH = 0.3
SIMILARITY_THRESHOLD = 0.7

# --- fixed values: labels and corpora ---------------------------------------------
LABEL_NAMES = {"spam": "phishing", "ham": "legitimate", "phish": "phishing", "OK": "legitimate"}
LABEL_NUMBERS = {"legitimate": 0, "phishing": 1}
# Stop words for the bag-of-words features (a parameter of the operator).
STOP_WORDS = [
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as",
    "at", "be", "because", "been", "before", "being", "both", "but", "by", "can",
    "could", "did", "do", "does", "down", "each", "few", "for", "from", "had",
    "has", "have", "he", "her", "here", "him", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "me", "more", "most", "my", "no", "nor", "not",
    "of", "off", "on", "once", "only", "or", "other", "our", "out", "over",
    "own", "same", "she", "so", "some", "such", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your",
]

# --- fixed values: advice and feed texts --------------------------------------------
ADVICE_PHISHING = [
    "Do not click on any links in this email",
    "Do not download or open any attachments",
    "Do not reply to this email",
]
ADVICE_NEW_DOMAIN = "This email is from a newly registered domain, which is suspicious"
ADVICE_AUTH = "This email failed authentication checks (SPF/DKIM/DMARC)"
ADVICE_LINKS = "Verify any mentioned organizations through official channels, not through links in this email"
ADVICE_SIMILAR = "This email is similar to known phishing attempts in our database"
ADVICE_MEDIUM = [
    "Exercise caution with this email",
    "Verify the sender through other channels before taking action",
]
ADVICE_HOVER = "Hover over links to verify their destination before clicking"
FEED_MAIL = (
    "Subject: Important Information\n\nDear User,\n\n"
    "Please click on the following link to update your information:\n{url}\n\n"
    "Regards,\nThe Team"
)
