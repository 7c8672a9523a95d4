"""Fixed values. They decide results, so they are written out plainly."""

# Sizes and thresholds.
MIN_PARAGRAPH_CHARS = 20
SNIPPET_CHARS = 600
PROMPT_PARAGRAPH_CHARS = 400
GENERATOR_PARAGRAPH_CHARS = 800
LEAF_SAMPLE_PARAGRAPHS = 5
SLUG_MAX_CHARS = 60
SIGNATURE_BODY_CHARS = 500
SAMPLE_CAP = 5
COVERAGE_OK = 0.95
GREY_SIMILARITY = 0.80
AUTO_SIMILARITY = 0.92
SIBLING_COHESION = 0.55
PARENT_DIVERGENCE = 0.15
EMBED_DIM = 1024
MIN_EMBED_DIM = 64
CHARS_PER_TOKEN = 4
CLEAR_TOKENS = 8000
COMPACT_TOKENS = 12000
KEEP_TOOL_RESULTS = 3
KEEP_USER_TURNS = 2
MAX_STEPS = 4
CHAT_TOP_K = 3
AGENT_TOP_K = 8
SCHEMA_VERSION = "v3"

# BM25 constants of the common Okapi variant: k1, b, epsilon.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# Boundary between paragraphs: one or more blank lines.
BLANK_LINE = r"\n\s*\n+"

# Word patterns: retrieval words, and words that feed the hashed bag of words.
RETRIEVAL_WORD = "[a-z0-9]+"
EMBED_WORD = "[a-z][a-z0-9]+"

# Boilerplate patterns (label, pattern), applied in this order.
GENERIC_PATTERNS = [
    ("url", r"(?i)https?://\S+"),
    ("bare_domain", r"(?i)\bwww\.[a-z0-9\-]+\.[a-z]{2,}\S*\b"),
    (
        "coaching_name",
        r"(?i)\b(?:vedantu|utkarsh|byjus?|testbook|adda247|drishti|"
        r"khan\s*global|unacademy|physicswallah|pw|springboard\s*academy)"
        r"\b[^\n]*",
    ),
    ("email", r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("social_handle", r"@[a-zA-Z0-9_]{4,}"),
    ("downloaded_from", r"(?i)downloaded\s+from[^\n]*"),
    ("pagination", r"(?i)\bpage\s+\d+\s+of\s+\d+\b"),
    ("copyright", r"©\s*\d{4}[^\n]*"),
    (
        "social_join",
        r"(?i)(?:join|subscribe)[^\n]*(?:telegram|whatsapp|youtube|channel)[^\n]*",
    ),
]

# Opt-in pattern bundles per source.
SOURCE_BUNDLES = {
    "springboard_rajasthan": [
        ("address_block", r"(?i)A-1\s+Keshav\s*Vihar[^\n]*\n[^\n]*30201\d[^\n]*"),
        ("address_line", r"(?i)A-1\s+Keshav\s*Vihar[^\n]*"),
        ("address_line", r"(?i)Jaipur-\s*302018[^\n]*"),
        ("page_marker", r"(?im)^\s*SPRINGBOARD\s+ACADEMY\s+\d+\s*$"),
        ("book_header", r"(?im)^\s*Rajasthan\s+Geography\s+Notes\s*$"),
        ("book_footer", r"(?i)Raj\.\s*Geo\.?\s*Notes\s*\(RAS\s*Pre\)"),
        ("phone_number", r"\b0?\d{3,4}[-\s]?\d{7,10}\b"),
        ("mobile_label", r"\bMob\.?:\s*\d[\d,\s\-]{8,}"),
    ],
}
# A caseless literal without which the labelled pattern cannot match: a plain scan saves the regex.
PATTERN_LITERALS = {"url": "://", "email": "@", "social_handle": "@", "copyright": "©"}
EXCESS_BLANKS = r"(?:[ \t]*\n){3,}"

# Publisher (lower case) to authority rank; a lower rank wins; unknown is 3.
AUTHORITY_RANK = {
    "ncert": 0,
    "rbse": 1,
    "rajasthan board of secondary education": 1,
    "springboard": 2,
    "springboard academy": 2,
    "coaching": 2,
}
DEFAULT_RANK = 3

# Names that must never show up in user-visible text.
BRAND_TOKENS = ["Springboard", "Academy", "RBSE", "NCERT", "Vedantu", "Utkarsh", "Drishti"]

# Hosts a source may come from.
ALLOWED_HOSTS = ["ncert.nic.in", "rajeduboard.rajasthan.gov.in"]

SUBJECT_SCOPES = ["rajasthan", "pan_india", "world"]
DEFAULT_SUBJECT_SCOPE = "pan_india"

# Message formats that other programs read.
TOOL_RESULT_PREFIX = "TOOL_RESULT (lookup_skill_content"
CLEARED_PLACEHOLDER = "[earlier TOOL_RESULT cleared to save context — re-search if needed]"
SUMMARY_PATTERN = r"(?is)<summary>(.*?)</summary>"
INLINE_TOOL_PATTERN = r"(?s)<\|tool_call\|>(.*?)<\|?/?tool_call\|?>"
FENCE_PATTERN = r"(?s)^```(?:json)?\s*(.*?)\s*```\s*$"
NO_DRAFT_CHAPTERS = "(no draft chapters — the model must discover structure from paragraphs)"
NO_BOOKMARKS = (
    "(no PDF bookmarks found — draft is a single chapter containing "
    "all paragraphs; please propose a real chapter structure)"
)
NO_ANSWER_FALLBACK = (
    "I couldn't find enough source content to answer "
    "with confidence. Try rephrasing or narrowing the topic."
)

CHOICES = ["A", "B", "C", "D"]
DIFFICULTIES = ["easy", "medium", "hard"]
BLOOM_LEVELS = ["remember", "understand", "apply", "analyze"]

# Titles too vague to name a topic.
VAGUE_TITLE = r"(?i)^(?:(?:chapter|section)\s+\w{1,3}|introduction|other|miscellaneous)$"

# White space Python strips from string ends.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
