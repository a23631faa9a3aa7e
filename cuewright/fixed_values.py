"""Word lists, lookup tables, limits and formats that results depend on."""

from __future__ import annotations

# ---- whitespace -------------------------------------------------------------------------------
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---- sentence rebuild -------------------------------------------------------------------------
SENTENCE_END = (".", "!", "?", "…")
SOFT_PAUSE = (",", ";", "-")
CONJUNCTIONS = ("and", "but", "because", "so", "which", "that")
PAUSE_ALPHA = 1.5
CAPTION_PAUSE_ALPHA = 2.0
SENTENCE_MAX_WORDS = 20
SENTENCE_MIN_WORDS = 4
MIN_CUE_SECONDS = 0.05

# ---- chunking and retrieval -------------------------------------------------------------------
CHUNK_TARGET_CHARS = 900
CHUNK_MAX_CHARS = 1200
CHUNK_OVERLAP_SEGMENTS = 2
TEXT_CHUNK_SIZE = 500
TEXT_CHUNK_OVERLAP = 100
TEXT_SEPARATORS = ("\n\n", "\n", ".", " ", "")
RAG_VERSION = "subtitle-v1"
SIMILARITY_THRESHOLD = 0.55
FETCH_K = 30
FINAL_K = 10
FALLBACK_K = 3
SHOWN_SOURCES = 5
RRF_K = 60
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
WEB_AUTO_THRESHOLD = 0.55
SNIPPET_CHARS = 300
SUMMARY_CONTEXT_CHARS = 4000
TRANSCRIPT_CAP_CHARS = 28000
TRANSCRIPT_CAP_LINE = "[Transcript đã được cắt ngắn để vừa context.]"

# ---- context headings -------------------------------------------------------------------------
CONTEXT_POLICY = (
    "## Cách dùng ngữ cảnh:\n"
    "Trả lời dựa trên các đoạn của video dưới đây; số phút và giây đứng trước mỗi đoạn cho biết chỗ của nó."
)
CONTEXT_SUMMARY = "## Tóm tắt video:\n"
CONTEXT_CHUNKS = "## Đoạn trích video (chunks):\n"
CONTEXT_NO_CHUNKS = "(không có chunks)"
CONTEXT_WEB = "## Kết quả web search:\n"
CONTEXT_HISTORY = (
    "## Những lượt hỏi đáp trước:\n"
    "Phần này chỉ giúp hiểu câu hỏi mới nhắc lại điều gì đã nói.\n"
)
CONTEXT_QUESTION = "## Câu hỏi: "
HISTORY_USER_CHARS = 800
HISTORY_ASSISTANT_CHARS = 1200

# ---- density ----------------------------------------------------------------------------------
SOURCE_UNITS_PER_SEC = 6.0
MIN_UNITS_PER_SEC = 3.2
TARGET_UNITS_PER_SEC = 4.5
MAX_UNITS_PER_SEC = 5.2
TOLERANCE_RATIO = 0.4
TOLERANCE_MIN = 3
NORMALIZATION_VERSION = 4

# ---- translation batches ----------------------------------------------------------------------
MANUAL_BATCH_SIZE = 90
API_BATCH_SIZE = 50
API_MAX_CHARS = 4000
RETRY_MIN_LINES = 5
RETRY_MAX_DEPTH = 3
CHAPTER_HEADER = "[chapters]"
SOURCE_MARKER = "DỮ LIỆU NGUỒN"

# ---- timing -----------------------------------------------------------------------------------
MIN_RANGE_SECONDS = 0.5
MIN_SPEECH_SECONDS = 0.2
MERGE_GAP_SECONDS = 0.3
MERGE_MAX_CHARS = {"supertonic": 20, "omnivoice": 0}
ORIGINAL_VOICE_PERCENT = 40.0
ORIGINAL_VOICE_CURVE = 2.0
SPEED_MIN = 0.9
SPEED_MAX = 1.5
SPEED_ALPHA = 4.0
GENERATION_DELTA_ALPHA = 1.2
GENERATION_DELTA_MIN = 0.3
LEGACY_TIMING_KEYS = (
    "tts_start",
    "tts_end",
    "tts_duration",
    "output_speed",
    "playback_start",
    "playback_end",
    "playback_duration",
    "tts_playback_start",
    "tts_playback_end",
    "tts_playback_duration",
)

# ---- voice reference window -------------------------------------------------------------------
REFERENCE_SEGMENTS = 8
REFERENCE_MAX_GAP = 1.25
REFERENCE_MIN_SECONDS = 3.0
REFERENCE_MAX_SECONDS = 10.0
REFERENCE_TARGET_SECONDS = 7.0
REFERENCE_MIN_LETTERS = 24

# ---- frames -----------------------------------------------------------------------------------
FRAME_MS = 20
SILENCE_DB = -35.0
ACTIVE_DB = -45.0
ACTIVE_HEAD_MS = 40
ACTIVE_TAIL_MS = 180
SILENCE_MIN_PAUSE = 0.04
PROTECT_RATIO = 0.3
PROTECT_MULTIPLIER = 3.0

# ---- run log ----------------------------------------------------------------------------------
RUN_LOG_COLUMNS = (
    "run_id",
    "video_id",
    "run_index",
    "duration_min",
    "mode",
    "asr_engine",
    "asr_time_sec",
    "tts_engine",
    "tts_batch_size",
    "tts_time_sec",
    "total_time_sec",
    "status",
    "error",
    "created_at",
)
NAN = "NaN"

# ---- labels -----------------------------------------------------------------------------------
ENGINE_LABELS = {"omnivoice": "OmniVoice - GPU", "supertonic": "Supertonic - CPU"}
VOICE_LABELS = {"M5": "Giọng nam", "F5": "Giọng nữ"}

# ---- glossary ---------------------------------------------------------------------------------
BUILTIN_GLOSSARY = {
    "RAM": "ram",
    "ROM": "rôm",
    "VRAM": "vi ram",
    "LAN": "lan",
    "SIM": "sim",
    "PIN": "pin",
    "NASA": "na sa",
    "NVIDIA": "en vi đi ei",
}

# ---- spoken forms -----------------------------------------------------------------------------
LETTER_NAMES_EN = {
    "A": "ei", "B": "bi", "C": "si", "D": "đi", "E": "i", "F": "ép", "G": "ji", "H": "ếch",
    "I": "ai", "J": "jei", "K": "kei", "L": "eo", "M": "em", "N": "en", "O": "ou", "P": "pi",
    "Q": "kiu", "R": "a", "S": "es", "T": "ti", "U": "diu", "V": "vi", "W": "đúp liu", "X": "ek",
    "Y": "wai", "Z": "zi",
}
LETTER_NAMES_VI = {
    "A": "a", "B": "bê", "C": "xê", "D": "đê", "E": "e", "F": "ép", "G": "gờ", "H": "hát",
    "I": "i", "J": "ji", "K": "ca", "L": "lờ", "M": "mờ", "N": "nờ", "O": "ô", "P": "pê",
    "Q": "quy", "R": "rờ", "S": "ết", "T": "tê", "U": "u", "V": "vê", "W": "đúp liu", "X": "ích",
    "Y": "y", "Z": "dét",
}
DIGIT_NAMES = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")
ONES_AFTER_TENS = {1: "mốt", 4: "tư", 5: "lăm"}
SCALE_NAMES = ("", "nghìn", "triệu", "tỷ")
UNIT_NAMES = {
    "kb": "ki lô bai", "mb": "mê ga bai", "gb": "gi ga bai", "tb": "tê ra bai",
    "khz": "ki lô héc", "mhz": "mê ga héc", "ghz": "gi ga héc", "hz": "héc",
    "kw": "ki lô oát", "mw": "mê ga oát", "ms": "mi li giây",
    "kg": "ki lô gam", "mg": "mi li gam",
    "km": "ki lô mét", "cm": "xen ti mét", "mm": "mi li mét", "ml": "mi li lít",
}
QUOTES_TO_DOUBLE = "“”„‟«»‹›"
QUOTES_TO_SINGLE = "‘’‚‛`´"
PATH_NAMES = {"/": "siệt", ".": "chấm"}
OPERATOR_NAMES = {"=": "bằng", "+": "cộng", "-": "trừ", "*": "nhân", "/": "chia"}

# ---- Vietnamese letters used to tag a title -----------------------------------------------------
VIETNAMESE_LETTERS = (
    "ăâđêôơưĂÂĐÊÔƠƯ"
    "àáạảãằắặẳẵầấậẩẫèéẹẻẽềếệểễìíịỉĩòóọỏõồốộổỗờớợởỡùúụủũừứựửữỳýỵỷỹ"
    "ÀÁẠẢÃẰẮẶẲẴẦẤẬẨẪÈÉẸẺẼỀẾỆỂỄÌÍỊỈĨÒÓỌỎÕỒỐỘỔỖỜỚỢỞỠÙÚỤỦŨỪỨỰỬỮỲÝỴỶỸ"
)
