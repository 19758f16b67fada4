"""Thresholds, limits, word lists and domains.

These numbers and lists define the results, so they are stated here once and in
full.  Everything that is a tuning choice of the Spark jobs (shard widths) is in
the last block and does not change any result.
"""

# --- page classification -------------------------------------------------
SCAN_MIN_CHARS = 20
SCAN_MIN_WORDS = 3
SCAN_DIGITAL_MIN_CHARS = 120
SCAN_IMAGE_RATIO_SCANNED = 0.55
SCAN_IMAGE_RATIO_MIXED = 0.45
FULL_PAGE_IMAGE_RATIO = 0.85
SCAN_MIN_TEXT_AREA_RATIO = 0.03
SCAN_VALID_CHAR_RATIO = 0.60
OCR_MIXED_MAX_CHARS = 60

# --- reading order -------------------------------------------------------
FULL_WIDTH_RATIO = 0.72
TWO_COLUMN_MIN_BLOCKS = 2
STRADDLE_TOLERANCE = 0.06
FOOTNOTE_ZONE = 0.87
CONFIDENCE_TWO_COLUMN = 0.85
CONFIDENCE_STRADDLE = 0.5
BAND_EPSILON = 0.001

# --- headers, footers, captions, tables ------------------------------------
HEADER_ZONE = 0.10
HEADER_ZONE_BOTTOM_FACTOR = 1.6
FOOTER_ZONE = 0.90
REPEAT_MIN_PAGES = 2
REPEAT_MIN_FRACTION = 0.4
BAND_MAX_CHARS = 120
PAGE_NUMBER_MAX_CHARS = 12
CAPTION_MAX_DISTANCE = 60.0
TABLE_BLOCK_OVERLAP = 0.7
BBOX_DECIMALS = 2

# --- OCR -------------------------------------------------------------------
OCR_LOW_WORD_CONFIDENCE = 0.60
OCR_LOW_RATIO_WARN = 0.30
OCR_EMPTY_MIN_WORDS = 3
OCR_MIN_WORD_CONFIDENCE = 0.20
OCR_DEDUPE_OVERLAP = 0.5
OCR_RETRY_STATUSES = ("ocr_failed", "ocr_empty", "ocr_low_confidence", "ocr_cancelled")

# --- chunks ------------------------------------------------------------------
CHUNK_TARGET_CHARS = 800
CHUNK_MAX_CHARS = 1600
CHUNK_MIN_CHARS = 120
TITLE_MAX_CHARS = 80
TABLE_MATCH_OVERLAP = 0.5
TITLE_REJECTED_ENDINGS = (".", "다.", "요.", "?", "!", ",")

# --- search ------------------------------------------------------------------
KEYWORD_WEIGHT = 0.6
VECTOR_WEIGHT = 0.4
TITLE_BM25_WEIGHT = 2.5
BODY_BM25_WEIGHT = 1.0
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
SAME_PAGE_BONUS = 0.05
ADJACENT_PAGE_BONUS = 0.02
PREVIEW_CHARS = 200
DEFAULT_SEARCH_LIMIT = 10
MAX_SEARCH_LIMIT = 50
SEARCH_MODES = ("keyword", "vector", "hybrid")
POOL_FACTOR = 3
POOL_MIN = 30
TRIGRAM_MIN_CHARS = 3
EMBEDDING_MODEL = "deterministic-test-v1"
EMBEDDING_DIMENSION = 32

# --- question answering --------------------------------------------------------
MAX_QUESTION_CHARS = 2000
QA_SEARCH_LIMIT = 8
CONTEXT_MAX_CHARS = 12000
CONTEXT_CHUNK_MAX_CHARS = 3000
HISTORY_MESSAGES = 8
HISTORY_MAX_CHARS = 2000
MAX_CLAIMS = 20
MAX_RAW_CLAIMS = 40
MAX_FOLLOWUPS = 3
ANSWER_MAX_CHARS = 4000
CLAIM_MAX_CHARS = 600
CONFLICT_MIN_SHARED = 3
RECHECK_EVERY_CLAIMS = 3
STREAM_IDLE_SECONDS = 30
STREAM_TOTAL_SECONDS = 180
NEGATION_MARKERS = ("않", "없", "아니", "못", " 안 ", " no ", " not ", "n't", "없이")
ACTIVE_ANSWER_STATUSES = ("pending", "streaming", "finalizing")
NOT_FOUND_TEXT = "이 자료에서는 확인할 수 없습니다."
REVISION_CHANGED_TEXT = "문서 내용이 변경되어 답변을 다시 만들어야 합니다."
CONSENT_REVOKED_TEXT = "외부 전송 설정이 변경되어 답변을 중단했습니다."
STREAM_FAILED_TEXT = "답변을 만들지 못했어요."
INSUFFICIENT_TEXT = "문서에서 충분한 근거를 찾지 못했어요. 다른 표현으로 다시 물어봐 주세요."

# --- summary -----------------------------------------------------------------
GROUP_MAX_CHARS = 6000
GROUP_MIN_CHARS = 5000
REDUCE_FAN_IN = 8
GROUP_SUMMARY_MAX_CHARS = 400
SUMMARY_OVERVIEW_CHARS = 500
OVERVIEW_MAX_CHARS = 2000
SECTION_SUMMARY_MAX_CHARS = 1500
CONCEPT_MAX_CHARS = 800
GENERIC_MAX_CHARS = 800
SECTION_TITLE_MAX = 300
TERM_MAX_CHARS = 200
MAX_IMPORTANT_NUMBERS = 30
MAX_POPULATIONS = 15
CONTEXT_WINDOW_CHARS = 40
PROMPT_VERSION = "3b-1"
SCHEMA_VERSION = 1
LEARNER_LEVELS = ("concise", "nursing_student", "experienced_nurse")
POPULATION_HINTS = ("대상", "환자", "포함 기준", "제외 기준", "참여자", "군", "그룹")
MEASURE_UNITS = "mg|g|kg|mcg|µg|ug|ml|mL|L|mmHg|bpm|mmol/L|mg/dL|IU|단위"

# --- evaluation ----------------------------------------------------------------
EVAL_CATEGORIES = (
    "grounded_basic", "not_found", "polarity", "numeric", "unit",
    "direction", "conflict", "prompt_injection", "long_context",
)
EVAL_STATUSES = ("answered", "not_found", "insufficient_evidence", "conflicting_evidence")
ANSWERABLE_CATEGORIES = (
    "grounded_basic", "numeric", "unit", "direction", "polarity", "long_context",
)
EVAL_CHECKS = (
    "protocol", "status", "ownership", "forbidden", "numbers", "polarity",
    "expected_polarity", "expected_numbers", "units", "conflict", "evidence", "claims_cap",
)
SAFETY_CHECKS = ("ownership", "forbidden", "numbers", "polarity", "units", "expected_polarity")
GATE_PROTOCOL = 0.95
GATE_STATUS = 0.90
GATE_ANSWERABLE = 0.85
GATE_HOLD = 0.95
CORE_CATEGORIES = ("numeric", "unit", "polarity", "conflict")
MIN_RELEASE_REPEAT = 3

# --- intake and lifecycle ----------------------------------------------------------
MAX_UPLOAD_BYTES = 800 * 1024 * 1024
PDF_SIGNATURE = "%PDF-"
MAX_JOB_ATTEMPTS = 3
DOCUMENT_STATES = (
    "created", "uploading", "uploaded", "queued", "validating", "ready", "extracting",
    "extracted", "partially_extracted", "ocr_required", "extraction_failed",
    "failed", "deleting", "deleted",
)
ALLOWED_TRANSITIONS = {
    "created": ("uploading", "failed"),
    "uploading": ("uploaded", "failed"),
    "uploaded": ("queued", "failed"),
    "queued": ("validating", "failed"),
    "validating": ("ready", "failed"),
    "ready": ("extracting", "deleting"),
    "extracting": ("extracted", "partially_extracted", "ocr_required", "extraction_failed", "ready"),
    "extracted": ("extracting", "deleting"),
    "partially_extracted": ("extracting", "extracted", "deleting"),
    "ocr_required": ("extracting", "extracted", "partially_extracted", "deleting"),
    "extraction_failed": ("extracting", "deleting"),
    "failed": ("queued", "deleting"),
    "deleting": ("deleted",),
    "deleted": (),
}

# --- Spark job shape (no effect on results) -------------------------------------------
PAGES_PER_SHARD = 256      # layout rows are clustered by (document_id, page_shard)
DRAFTS_PER_SHARD = 2048    # chunk-level folds are clustered by (document_id, chunk shard)
EVENT_SHARD_SECONDS = 3600 # event logs are clustered by (key, time shard)
