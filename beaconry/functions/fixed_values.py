"""Fixed values.

Word lists, lookup tables, patterns, limits and texts below must have exactly
these values (and, where a first match wins, this order) for results to be
right.  All of them are defaults of function parameters and can be replaced.
"""

# Category key -> icon.  The first key contained in the text wins.
CATEGORY_ICONS = {
    "authentication": "🔐",
    "authorization": "🛡️",
    "cryptography": "🔒",
    "injection": "💉",
    "session": "📋",
    "input": "📝",
    "output": "📤",
    "api": "🔌",
    "web": "🌐",
    "mobile": "📱",
    "database": "🗄️",
    "cloud": "☁️",
    "docker": "🐳",
    "kubernetes": "⚙️",
    "network": "🌍",
    "logging": "📊",
    "error": "⚠️",
    "file": "📁",
    "xml": "📄",
    "json": "📋",
    "deserialization": "🔄",
    "csrf": "🎭",
    "xss": "💥",
    "clickjacking": "🖱️",
    "password": "🔑",
    "jwt": "🎫",
    "oauth": "🔓",
    "saml": "📜",
    "ldap": "📚",
    "sql": "🗃️",
    "nosql": "📦",
    "graphql": "📈",
    "rest": "🔗",
    "microservices": "🧩",
    "serverless": "⚡",
    "ci/cd": "🔄",
    "default": "📋",
}
DEFAULT_CATEGORY_ICON = "📋"

# Second-chance categories, tried in order after the keys above.
CATEGORY_FALLBACKS = [
    ("Authentication", ["auth", "login", "password", "credential"]),
    ("Injection", ["inject", "sql", "xss", "command"]),
    ("API Security", ["api", "rest", "graphql"]),
    ("Web Security", ["web", "http", "browser"]),
    ("Cryptography", ["crypto", "encrypt", "hash"]),
]
DEFAULT_CATEGORY = "General"

# Severity words (substring match, first level wins), icons, colours.
SEVERITY_KEYWORDS = {
    "critical": ["critical", "severe", "catastrophic", "emergency", "extremely dangerous"],
    "high": ["high", "serious", "major", "significant", "dangerous", "important"],
    "medium": ["medium", "moderate", "notable", "considerable"],
    "low": ["low", "minor", "minimal", "limited"],
}
DEFAULT_SEVERITY = "Medium"
SEVERITY_ICONS = {"Critical": "🔴", "High": "🟠", "Medium": "🟡", "Low": "🟢"}
DEFAULT_SEVERITY_ICON = "⚪"
SEVERITY_COLORS = {
    "Critical": "#ff4b4b",
    "High": "#ff8c00",
    "Medium": "#ffd700",
    "Low": "#32cd32",
}
DEFAULT_SEVERITY_COLOR = "#888"
DEFAULT_RISK_ICON = "⚠️"

# Words that mark a section as a risk, an attack, boilerplate.
RISK_KEYWORDS = [
    "vulnerability", "risk", "threat", "attack", "weakness",
    "exploit", "injection", "bypass", "disclosure", "exposure",
]
SECURITY_TERMS = [
    "secure", "security", "protect", "prevent", "attack",
    "vulnerability", "exploit", "malicious", "unauthorized",
    "injection", "bypass", "sensitive", "credential", "token",
]
SECURITY_TERMS_NEEDED = 2
ATTACK_KEYWORDS = ["attack", "exploit", "example", "scenario", "case study"]
BOILERPLATE_TITLES = ["navigation", "footer", "sidebar"]
WARNING_MARKS = ["warning", "caution", "danger", "note:"]
TIP_MARKS = ["tip:", "best practice", "recommendation"]
IMPACT_TRIGGERS = ["impact", "effect", "result", "consequence"]
MITIGATION_TRIGGERS = [
    "mitigation", "prevention", "defense", "protect", "secure", "recommendation",
]
CONTRIBUTOR_MARKS = ["author", "contributor"]
INTRO_HEADINGS = ["introduction", "overview", "about", "summary"]

# Recommendation patterns, in order.
RECOMMENDATION_PATTERNS = [
    r"(?:do|should|must|always|ensure|use|implement)[\s:]+([^\.]+\.)",
    r"(?:don't|should not|must not|never|avoid)[\s:]+([^\.]+\.)",
    r"(?:recommend|best practice|tip)[\s:]+([^\.]+\.)",
]

# What makes a line look like code.
CODE_LINE_PREFIXES = [
    "import ", "from ", "def ", "class ", "if ", "for ", "while ",
    "const ", "let ", "var ", "function ",
    "<", "{", "[", "//", "#!", "#!/",
    "tools=", "commands",
]
CODE_LINE_SUFFIXES = [";", "{", "}", ":"]

# Link and title patterns.
GUIDANCE_HREF = r"cheatsheets/.*_Cheat_Sheet\.html"
GUIDANCE_ID = r"cheatsheets/(.+)_Cheat_Sheet\.html"
LOOSE_ID = r"(?i)cheatsheets/([^/]+)_Cheat_Sheet"
LANGUAGE_HREF = r"cheatsheets/.*\.html"
RELATED_ID = r"([^/]+)_Cheat_Sheet"
LOOSE_WORD = "cheat"
SITEMAP_MARKS = ["_Cheat_Sheet", "/cheatsheets/"]
TITLE_KIND_SUFFIX = r"\s*Cheat\s*Sheet\s*$"

# Numbered-risk documents.
RISK_HEADING = r"^#+\s*(A0?\d{1,2})\s*[:\-–]\s*(.+)$"
RISK_LABEL = r"\bA0?(\d{1,2})\s*[:\-–]\s*(.+)"
RISK_HREF = r"/Top10/2025/(A0\d|A10)_2025-([A-Za-z0-9_\-]+)/?"
BUCKET_PREFIXES = [
    ("impact", "impacts"),
    ("mitigation", "mitigations"),
    ("prevention", "mitigations"),
    ("example", "examples"),
    ("type", "types"),
    ("categories", "types"),
]
MARKDOWN_KEYS = {
    "impacts": ["impact", "risk", "consequence"],
    "mitigations": ["prevention", "mitigation", "how to prevent", "how to protect", "controls"],
    "examples": ["example", "scenario", "attack"],
    "types": ["type", "category", "key concepts"],
}
HTML_KEYS = {
    "impacts": ["impact", "consequence", "risk"],
    "mitigations": [
        "prevention", "mitigation", "how to prevent", "how to fix", "controls", "defense",
    ],
    "examples": ["example", "scenario", "attack"],
    "types": ["what is", "overview", "description", "category", "types"],
}
DESCRIPTION_HEADERS = ["overview", "description", "about"]

# Texts shown when something is missing or cut.
EMPTY_DESCRIPTION = "No short description; the page itself has the details."
NO_IMPACTS = "No impact listed"
NO_MITIGATIONS = "No mitigation listed"
DETAIL_HINTS = {
    "types": "No kinds listed; the sections of the page may name some.",
    "impacts": "No impacts listed on this page.",
    "mitigations": "No mitigations listed on this page.",
    "examples": "No code examples listed on this page.",
}
SCENARIO_PROMPT = "No example listed"
SCENARIO_IMPACT = "Impact not listed"
SCENARIO_MITIGATION = "Mitigation not listed"
TRUNCATION_NOTICE = "\n\n[Truncated to fit context limit]"
REVIEW_INSTRUCTION = (
    "Judge the change by the guidance that follows and by nothing else; "
    "leave other rule sets aside."
)
NO_CONTEXT = "(no context provided)"
NO_PROMPT = "(none)"
UNREADABLE_FILE = "(file not readable)"

# Limits.
REVIEW_CHAR_LIMIT = 12_000
DESCRIPTION_CHARS = 500
INTRO_CHARS = 1_000
SNIPPET_CHARS = 200
CARD_CHARS = 150
SLUG_CHARS = 80
MIN_ITEM_CHARS = 10
MIN_RECOMMENDATION_CHARS = 20
MIN_DESCRIPTION_CHARS = 20
PAGE_TTL_DAYS = 90
INDEX_TTL_DAYS = 7
EVICTION_TARGET = 0.8
MAX_CACHE_BYTES = 500 * 1024 * 1024
REQUESTS_PER_MINUTE = 30

# Review vocabulary.
RISK_LEVELS = ["low", "medium", "high"]
DECISIONS = ["approve", "request changes", "escalate"]
APPROVAL_CONFIDENCE = 85
COVERAGE_STATUSES = ["not_observed", "needs_attention", "confirmed"]
