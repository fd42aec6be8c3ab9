"""Fixed values.

Everything in this module must equal the values the original corpus
builder uses, otherwise results differ.  They are stated here plainly and
together; the rest of the package takes them as default arguments only,
so callers can pass their own.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: filter thresholds (inclusive bounds, code points).
# ---------------------------------------------------------------------------
MIN_POST_SCORE = 10
MIN_COMMENT_SCORE = 25
MIN_CHARS = 50
MAX_CHARS = 1500
# main text: a post's stripped selftext shorter than this falls back to the title
MIN_SELFTEXT_CHARS = 20

# ---------------------------------------------------------------------------
# FIXED VALUES: near-duplicate rule.  Weighted character-trigram Jaccard,
# strictly greater than 4/5, written as integers: 5 * inter > 4 * union.
# ---------------------------------------------------------------------------
JACCARD_NUM = 4
JACCARD_DEN = 5
NGRAM = 3

# ---------------------------------------------------------------------------
# FIXED VALUES: bot markers, matched on the lower-cased filter text.
# ---------------------------------------------------------------------------
BOT_MARKERS = ["i am a bot", "this action was performed automatically", "beep boop"]

# ---------------------------------------------------------------------------
# FIXED VALUES: collection rules.
# ---------------------------------------------------------------------------
POST_KIND = "t3"
COMMENT_KIND = "t1"
COMMENTS_PER_POST = 10
MAX_PAGES_GENERAL = 4
MAX_PAGES_TARGETED = 3
MIN_COMMENTS_GENERAL = 10
MIN_COMMENTS_TARGETED = 5
TARGETED_SOURCE = "kd_scrape"

# ---------------------------------------------------------------------------
# FIXED VALUES: formatting, shuffle and split.
# ---------------------------------------------------------------------------
SEED = 42
P_DIRECT = 0.40          # roll < 0.40 -> direct template
P_TOPIC = 0.75           # roll < 0.75 with a topic -> topic template, else debate
TRAIN_PERCENT = 95       # cut = floor(n * 95 / 100); first part is train
SYNTHETIC_TARGET = 300   # keep the first 300 synthetic takes
MIN_TAKE_CHARS = 50
TOPIC_PLACEHOLDER = "{topic}"
COUNT_PLACEHOLDER = "{count}"

# ---------------------------------------------------------------------------
# FIXED VALUES: regular-expression spellings.
# Python's \s on U+0001..U+3000, spelled so Java (Spark) and RE2 (DuckDB)
# match the same code points.
# ---------------------------------------------------------------------------
WS_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_CLASS = r"\p{L}\p{N}_"
TOMBSTONES = ["[removed]", "[deleted]"]
EDIT_MARKER = "edit:"

# ---------------------------------------------------------------------------
# FIXED VALUES: instruction templates, in their original order.
# ---------------------------------------------------------------------------
DIRECT_TEMPLATES = [
    "Give me your hottest NBA take right now.",
    "What's your most controversial NBA opinion?",
    "Drop an NBA hot take that would get you yelled at on Twitter.",
    "What's an NBA opinion you'd defend to the death?",
    "Give me a spicy NBA take.",
    "What's your boldest NBA prediction?",
    "Hit me with an unpopular NBA opinion.",
    "What NBA take are you willing to die on?",
]

TOPIC_TEMPLATES = [
    "What's your hot take on {topic}?",
    "Give me your most controversial opinion about {topic}.",
    "What does everyone get wrong about {topic}?",
    "Drop a spicy take about {topic}.",
    "What's your unpopular opinion on {topic}?",
]

DEBATE_TEMPLATES = [
    "Is {topic} overrated or underrated? Explain.",
    "Make the case for or against {topic}.",
    "Defend this position: {topic}.",
    "What's the real truth about {topic} that nobody wants to hear?",
]

# FIXED VALUES: user prompts paired with synthetic takes
SYNTHETIC_USER_PROMPTS = [
    "Give me your hottest Kevin Durant take.",
    "Is KD the best scorer in NBA history?",
    "What makes Kevin Durant so special?",
    "Where does KD rank all time?",
    "What's your take on Kevin Durant's legacy?",
    "Is Durant underrated or properly rated?",
    "Give me your most controversial KD opinion.",
    "Why is Kevin Durant unstoppable?",
    "What does KD do better than anyone else in NBA history?",
    "Make the case that KD is top 10 all time.",
    "Drop a spicy take about Kevin Durant.",
    "What's your boldest KD prediction?",
    "Is Kevin Durant the most skilled player ever?",
    "What's the best Kevin Durant performance you've ever seen?",
    "Why don't people give KD enough credit?",
]

# FIXED VALUES: labels of the sort listings in the work list
SORT_LABELS = ["__top__", "__hot__"]

# FIXED VALUES: generation request defaults
GENERATION_MODEL = "meta-llama/llama-3.1-8b-instruct"
GENERATION_MAX_TOKENS = 2048
GENERATION_TEMPERATURE = 0.9
GENERATION_BATCH = 10

# Default system prompt for derived examples.  The original reads its prompt
# from a text file; pass `system_prompt=` (or read one with read_prompt) to
# use your own.  This default is our own wording.
DEFAULT_SYSTEM_PROMPT = (
    "You are a bold sports analyst who answers with conviction, backs claims "
    "with stats, and never hedges."
)

# Chat rendering delimiters (ChatML style); the real template lives in the
# tokenizer, so these are arguments, not a claim of byte parity.
CHAT_PREFIX = "<|im_start|>{role}\n"
CHAT_SUFFIX = "<|im_end|>\n"
