"""Fixed values that must equal the original corpus-preparation code for the
results to agree. They are stated here plainly, in their natural order."""

# --- fixed values: stop-word list of the book-review corpus (17 words, file order) ---
BOOK_STOP_WORDS = [
    "এই", "করে", "জন্য", "একটি", "আমার", "একটা", "এর", "যে", "তার",
    "এবং", "থেকে", "ও", "এ", "কি", "কোন", "আমি", "আর",
]

# --- fixed values: character ranges, as inclusive code-point intervals ---
# Bengali Unicode block U+0980..U+09FF (code points 2432..2559).
BENGALI_RANGES = ((0x0980, 0x09FF),)
# Bengali danda, kept by the comment cleaner although it lies outside the block.
DANDA_CP = 0x0964
# Latin letters A-Z, a-z, U+00C0..U+017F: the keep range on the (non-Bengali) driver fixtures.
LATIN_RANGES = ((0x41, 0x5A), (0x61, 0x7A), (0x00C0, 0x017F))

# --- fixed values: emoji / symbol class of the comment cleaner, 18 entries in
# source order (12 ranges, 6 single characters; one range appears twice) ---
EMOJI_CLASS_ENTRIES = [
    r"\x{1F600}-\x{1F64F}",  # emoticons
    r"\x{1F300}-\x{1F5FF}",  # symbols & pictographs
    r"\x{1F680}-\x{1F6FF}",  # transport & map symbols
    r"\x{1F1E0}-\x{1F1FF}",  # flags
    r"\x{2500}-\x{2BEF}",
    r"\x{2702}-\x{27B0}",
    r"\x{2702}-\x{27B0}",
    r"\x{24C2}-\x{1F251}",
    r"\x{1F926}-\x{1F937}",
    r"\x{10000}-\x{10FFFF}",
    r"\x{2640}-\x{2642}",
    r"\x{2600}-\x{2B55}",
    r"\x{200D}",
    r"\x{23CF}",
    r"\x{23E9}",
    r"\x{231A}",
    r"\x{FE0F}",
    r"\x{3030}",
]

# Python ``str.split()`` whitespace (``str.isspace``), as a regex class.
PY_WHITESPACE = (
    r"[\t\n\x{000B}\f\r\x{001C}-\x{001F} \x{0085}\x{00A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Default for the "digits / operators / punctuation / others" deleter: the
# original character tables are not available, so the default is the Unicode
# categories decimal digit, punctuation and symbol; pass an explicit list to
# reproduce a specific table.
DEFAULT_DROP_CLASS = r"[\p{Nd}\p{P}\p{S}]"

# --- fixed values: label coding ---
# Raw news-comment labels are 0 neutral, 1 positive, 2 negative; the engine's
# coding is 0 negative, 1 positive, 2 neutral. The recode is a swap.
NEWS_LABEL_SWAP = {0: 2, 1: 1, 2: 0}

# --- fixed values: split parameters ---
TEST_SHARE = 0.15
TEST_SEED = 42
VALID_TRAIN_SHARE = 0.85
VALID_SEED = 1234

# --- fixed values: encoding parameters ---
MAX_LEN = 400
BATCH_SIZE = 32
