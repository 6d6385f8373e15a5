"""Fixed values that must equal the reference behaviour for identical results.

All values below are stated plainly, in natural order, as fixed values.
"""

# --- fixed values: special tokens and their fallback ids -------------------
UNK_TOKEN = "[UNK]"
CLS_TOKEN = "[CLS]"
SEP_TOKEN = "[SEP]"
UNK_FALLBACK_ID = 100
CLS_FALLBACK_ID = 101
SEP_FALLBACK_ID = 102
CONTINUATION_PREFIX = "##"

# --- fixed values: character classes (code points) --------------------------
# CJK ideographs: U+4E00-U+9FFF, U+3400-U+4DBF, U+20000-U+2A6DF
# ASCII punctuation: 33-47, 58-64, 91-96, 123-126
# whitespace: space, tab, LF, CR, U+3000 (ideographic space) -- nothing else
CJK_CLASS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"
PUNCT_CLASS = r"!-/:-@\[-`{-~"
SPACE_CLASS = r" \t\n\r\x{3000}"

# --- fixed values: limits ----------------------------------------------------
MAX_SEQ = 512              # encoded length incl. CLS and SEP
MAX_CHUNKS = 512           # basic-tokeniser chunk cap
MAX_TEXT_CHARS = 2048      # service-path character clip
BATCH_MAX_ITEMS = 8        # dynamic batch size limit
BATCH_MAX_WAIT_MS = 5.0    # dynamic batch wait limit
MODEL_NAME = "bge-small-zh-v1.5"
REQUIRED_MODEL_FILES = ("model.safetensors", "vocab.txt")

# --- fixed values: numerics --------------------------------------------------
LAYER_NORM_EPS = 1e-12
ATTENTION_MASK_VALUE = -1e9
Q8_BLOCK = 32
PARITY_TOLERANCE = 1e-5
NORM_TOLERANCE = 1e-3
