"""Fixed values.

Everything in this module is a value that must be equal to what the
original newsletter tool uses for its results to match (word lists,
lookup tables, output formats).  They are stated once, plainly, in their
natural order.  Nothing else in the package hard-codes them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — keep in this order, do not edit to make a test pass.
# ---------------------------------------------------------------------------

# Phrases that mark a subject line as an announcement (matched as
# substrings of the lower-cased raw subject).
BREAKING_PHRASES = [
    "breaking", "just in", "just announced", "new release",
    "launches", "launched", "announces", "announced",
    "releases", "released", "introduces", "introduced",
    "unveils", "unveiled", "debuts", "just now",
]

# Substrings that disqualify a URL found in a message body as a homepage
# (case-sensitive, anywhere in the URL).
BODY_URL_BLOCKLIST = [
    "form", "track", "unsubscribe", "pixel", "img", "logo", "pricing",
    "cdn-cgi", "utm_", "jwt_token", "viewform",
]

# URL paths that count as a site root when picking a homepage.
ROOT_PATHS = ["", "/", "/home"]

# Curated newsletter name -> homepage; first match (in this order) wins.
CURATED_SITES = [
    ("the neuron", "https://www.theneurondaily.com"),
    ("tldr ai", "https://www.tldrnewsletter.com"),
    ("tldr", "https://www.tldrnewsletter.com"),
    ("the rundown ai", "https://www.therundown.ai"),
    ("ai breakfast", "https://aibreakfast.substack.com"),
    ("ben's bites", "https://www.bensbites.co"),
    ("alpha signal", "https://alphasignal.ai"),
    ("unwind ai", "https://unwindai.com"),
    ("simon willison", "https://simonwillison.net"),
    ("peter yang", "https://creatoreconomy.so"),
]

# Sender-domain prefixes removed (once) before the domain rule.
MAIL_HOST_PREFIXES = ["mail", "news", "info", "newsletter"]

# Registry quality rules: tracking substrings (on the lower-cased URL) and
# hosts that are too generic when used with an empty or "/" path.
REGISTRY_TRACKING_PATTERNS = [
    "track", "utm_", "pixel", "open?token=", "viewform",
    "unsubscribe", "cdn-cgi", "jwt_token",
]
GENERIC_HOSTS = ["substack.com", "gmail.com", "yahoo.com", "outlook.com"]

# Provider routing: provider -> (gateway model id, report label, direct model).
PROVIDER_MODELS = [
    ("claude", "anthropic/claude-sonnet-4", "claude-3-7-sonnet-20250219", "claude-3-7-sonnet-20250219"),
    ("openai", "openai/gpt-4.1-mini", "gpt-4.1-2025-04-14", "gpt-4.1-2025-04-14"),
    ("google", "google/gemini-2.5-flash", "gemini-2.5-flash-preview", "claude-3-7-sonnet-20250219"),
]
UNKNOWN_MODEL_LABEL = "unknown model"
CUSTOM_PROVIDER = "custom"
UNKNOWN_KEY = "unknown"

# Defaults of the original command-line tool.
DEFAULT_DAYS = 7
DEFAULT_NUM_TOPICS = 10
DEFAULT_COST_DAYS = 30
ITEM_CHAR_LIMIT = 3000
ITEM_SUFFIX = "..."

# Header defaults when a message lacks the header.
NO_SUBJECT = "No Subject"
NO_DATE = "No Date"
UNKNOWN_SENDER = "Unknown Sender"

# Output of the HTML cleaner when the body cannot be cleaned (e.g. NULL).
CLEAN_ERROR = "[ERROR: Could not clean/convert this email]"

# Report text (markdown).  Slots are filled by the report plan.
REPORT_TITLE = "# MESSAGE DIGEST"
REPORT_MODEL_LINE = "## Generated with {model}"
REPORT_ANALYSIS_HEADING = "## TOP AI DEVELOPMENTS"
REPORT_LATEST_HEADING = "## JUST IN: LATEST DEVELOPMENTS"
REPORT_LATEST_INTRO = (
    "These items are from the most recent newsletters (last 24 hours) "
    "and may represent emerging trends:"
)
REPORT_SOURCES_HEADING = "## NEWSLETTER SOURCES"
REPORT_SOURCES_INTRO = (
    "This week's insights were gathered from {n} newsletters across {s} sources:"
)
REPORT_METHODOLOGY_HEADING = "## METHODOLOGY"
REPORT_METHODOLOGY = (
    "This report was generated by analyzing AI newsletters with a focus on "
    "practical implications for regular users rather than industry competition."
)
REPORT_METHODOLOGY_MODEL = " Analysis performed using {model} on {ts}."
REPORT_FILE_PREFIX = "message_digest_"
REPORT_HOT_MARK = "🔥"
FRONT_MATTER_TITLE = "Message digest - {date}"

# Regular expressions the original applies.  Each pair is the original
# (Python ``re``) text and the same pattern in Java syntax as Spark runs it:
# Python's Unicode \w, \s and \d written out as classes, '.' limited to
# '\n' with (?d), literal braces escaped.  The SQL oracle drops (?d).
_PY_W = r"\p{L}\p{N}_"
_PY_S = (r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
RX_SUBJECT_TAG = (r"^\[.*?\]", r"(?d)^\[.*?\]")
RX_SUBJECT_PREFIX = (r"^.*?:", r"(?d)^.*?:")
RX_SENDER = (r"(.*?)\s*<(.+?)>", rf"(?d)^(.*?){_PY_S}*<(.+?)>")   # used with re.match
RX_NORMALIZE = (r"[^a-z0-9]", r"[^a-z0-9]")
RX_MAIL_PREFIX = (r"^(mail|news|info|newsletter)\.", r"^(?:mail|news|info|newsletter)\.")
RX_URL = (r"https?://[\w\.-]+(?:/[\w\-\./?%&=]*)?", rf"https?://[{_PY_W}.\-]+(?:/[{_PY_W}\-./?%&=]*)?")
RX_CSS_MEDIA = (r"(?s)@media[^{]+{[^}]+}", r"(?s)@media[^{]+\{[^}]+\}")
RX_CSS_RULE = (r"(?s)\.[\w\-]+[^{]*{[^}]+}", rf"(?s)\.[{_PY_W}\-]+[^{{]*\{{[^}}]+\}}")
RX_CSS_BRACES = (r"(?s){[^}]+}", r"(?s)\{[^}]+\}")
RX_TOPIC_TITLE = (r"###\s*\d+\.\s*(.*?)\n", rf"(?d)###{_PY_S}*\p{{Nd}}+\.{_PY_S}*(.*?)\n")

# Python's str.isspace() set, used wherever the original calls strip().
PY_WHITESPACE_CLASS = _PY_S

# The same set as characters, for trim(BOTH ... FROM ...).
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# RFC 2822 parsing (Python email.utils): month names and named zones.
MONTH_ABBR = ["jan", "feb", "mar", "apr", "may", "jun",
              "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_FULL = ["january", "february", "march", "april", "may", "june", "july",
              "august", "september", "october", "november", "december"]
ZONE_OFFSETS_HHMM = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -400, "ADT": -300, "EST": -500, "EDT": -400,
    "CST": -600, "CDT": -500, "MST": -700, "MDT": -600,
    "PST": -800, "PDT": -700,
}

# ---------------------------------------------------------------------------
# Build parameters (ours, not the original's).
# ---------------------------------------------------------------------------

# Items per prompt.  The original packs everything into one prompt; here a
# prompt is bounded so no group grows with the corpus.
PROMPT_BATCH_ITEMS = 50
# Replies merged by one prompt, and prompts whose answers a task commits at once.
MERGE_FAN_IN = 10
PROMPTS_PER_COMMIT = 64

# Registry validation messages (slots: name, url, first owner, value repr).
MSG_BLANK_NAME = "Newsletter name must be a non-empty string: {name_repr}"
MSG_NAME_WHITESPACE = "Newsletter name has leading/trailing whitespace: {name_repr}"
MSG_NOT_OBJECT = "Configuration for '{name}' must be a dictionary"
MSG_MISSING_URL = "Missing 'url' field for newsletter '{name}'"
MSG_MISSING_VERIFIED = "Missing 'verified' field for newsletter '{name}'"
MSG_URL_NOT_STRING = "URL for '{name}' must be a string: {url_repr}"
MSG_INVALID_URL = "Invalid URL for '{name}': {url}"
MSG_TRACKING = "URL for '{name}' appears to be a tracking/temporary URL: {url}"
MSG_GENERIC = "URL for '{name}' is too generic, should be more specific: {url}"
MSG_DUPLICATE = "Duplicate URL found: '{name}' and '{first}' both use {url}"
MSG_VERIFIED_NOT_BOOL = "'verified' field for '{name}' must be a boolean: {verified_repr}"
MSG_FILE_MISSING = "Newsletter websites file not found: {path}"
MSG_BAD_JSON = "Invalid JSON in {path}: {err}"
MSG_ROOT_NOT_OBJECT = "Root element must be a dictionary in {path}"
REGISTRY_CATEGORY = "newsletter_websites"
