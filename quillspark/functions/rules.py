"""Fixed values of the rules: code point classes, patterns, limits, keyword tables, bands. Results depend on them as they stand."""

# Code point classes, first match wins: rule id, label, ranges.
UNICODE_CLASSES = [
    ("unicode.zero_width", "zero-width carrier", [(0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF)]),
    ("unicode.bidi_control", "bidi control", [(0x202A, 0x202E), (0x2066, 0x2069)]),
    ("unicode.tag", "Unicode tag character", [(0xE0000, 0xE007F)]),
    ("unicode.variation_selector", "variation selector", [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]),
    ("unicode.exotic_space", "exotic space", [(0x00A0, 0x00A0), (0x1680, 0x1680), (0x180E, 0x180E), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0x2000, 0x200A)]),
]
PROBABLE_CLASSES = ["unicode.exotic_space", "unicode.variation_selector"]
REMOVABLE = [(0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF), (0x202A, 0x202E), (0x2066, 0x2069), (0xE0000, 0xE007F)]
JOINING_SCRIPTS = ["Arabic", "Syriac", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Kannada", "Malayalam"]

# Extended_Pictographic of Unicode 14.0, in hexadecimal.
PICTOGRAPHIC = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2605 2607-2612 2614-2685 "
    "2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 "
    "3030 303D 3297 3299 1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F3FA "
    "1F400-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD"
)

# Metadata patterns, all without regard to case.
FIELD = "(?:generator|software|creator|author|producer|application|provenance|tool|ai[-_])"
PROVENANCE = "(?:ai[-_ ]?(?:generated|assisted|tool)|content credentials|c2pa|provenance|watermark)"
META_TAG = r"""<meta\b[^>]*(?:name|property)=["'](?:generator|author|provenance|ai[^"']*)["'][^>]*>"""
DATA_AI = r"""\bdata-ai[^=\s>]*=(?:"[^"]*"|'[^']*')"""
SVG_METADATA = r"<metadata\b[^>]*>[\s\S]*?</metadata>"
DATA_URI = r"data:image/(png|jpe?g|webp|gif|bmp|tiff|avif|heic);base64,([a-z0-9+/=]+)"
SEGMENT_MANIFEST = "c2pa|content credentials|jumb"
RAW_MARKER = "c2pa|content credentials|ai[-_ ]generated"
ORDINARY_TOOL = "(?:generator|software|producer|application|tool)"
PROTECTED_VALUE = r"(?:accessibility|alt(?:ernative)?(?:\s+text)?|author|copyright|description|license|rights)"
FRONT_MATTER = r"^\x{FEFF}?---[ \t]*\r?\n[\s\S]*?\r?\n---(?:\r?\n|$)"

# Limits of one object (they guard worker memory) and of a run (parameters in our operators).
LIMITS = {"files": 1000, "bytes": 64 << 20, "data_uri_bytes": 8 << 20, "data_uri_total": 32 << 20, "data_uris": 1000, "entries": 10_000, "expanded": 256 << 20, "ratio": 200, "depth": 64, "directories": 10_000}
IGNORED_DIRS = [".git", "node_modules", ".cache"]
EXIT_CODES = {"clear": 0, "findings": 1, "degraded": 2, "unsafe": 64, "error": 70}
DEGRADED_CODES = ["remote_unsupported", "exiftool_failed", "c2patool_failed", "exiftool_timeout", "c2patool_timeout", "archive_compression_unsupported"]
CONTEXT_BUDGET = [("critical", 120_000), ("tight", 80_000), ("watch", 45_000)]

# Project rules.
CORE_FILES = ["WORK.md", "OUTLINE.md", "STYLE-GUIDE.md", "RECORD.md", "config.json"]
REVIEW_KEYWORDS = ["TODO", "FIXME", "UNRESOLVED", "NEEDS REVISION", "QUESTION: Blocking", "VOICE DRIFT", "CONTINUITY"]
OPEN_REVIEW_KEYWORDS = ["TODO", "FIXME", "UNRESOLVED", "NEEDS REVISION", "QUESTION: Blocking", "VOICE DRIFT"]
STYLE_PLACEHOLDERS = [r"\{\{[A-Z0-9_ -]+\}\}", r"(?i)\[(?:fill in|delete if not applicable)", r"(?i)\bTBD\b", r"(?i)\bTODO\b", r"(?i)\bplaceholder\b", "(?i)your writing voice"]
UNIT_REFERENCE = r"(?i)\b(?:unit|chapter|scene|section|act|part|surah|procedure|poem)\s*#?\s*(\d+)\b"
STATE_OPEN = "(?i)(open revisions|unresolved review|editor notes.*awaiting revision|awaiting revision|revisions pending)"
STATE_SUBMITTED = r"(?i)\b(submit|submitted)\b"

# Bands and targets of the prose rules.
TM_CONFIDENCE = [("high", 0.8), ("medium", 0.5)]
FIDELITY_BANDS = [("high", 90), ("medium", 75)]
THEME_BANDS = [("strong", 5), ("moderate", 2), ("emerging", 1), ("dormant", 0)]
WORDS_PER_PAGE, READ_FAST, READ_SLOW = 250, 250, 200

# Ours, where the prose rules give no number: tolerance of similar sentence lengths, words of a chunk, z-score of an outlying chunk.
SIMILAR_LENGTH, CHUNK_WORDS, CHUNK_Z = 0.15, 120, 2.0
