"""Lists, limits and formats whose exact content decides results."""

# Converter names and the packages a conversion is pinned to.
HEAVY = "marker"
LIGHT = "markitdown"
BACKEND_PACKAGES = {
    "marker": ["marker-pdf", "surya-ocr", "torch"],
    "markitdown": ["markitdown"],
}

# File formats each converter reads.
HEAVY_FORMATS = ["pdf", "docx", "pptx", "xlsx", "html", "epub", "png", "jpg", "jpeg",
                 "tiff", "tif", "webp", "gif", "bmp"]
LIGHT_FORMATS = ["pdf", "docx", "pptx", "xlsx", "xls", "html", "htm", "csv", "json", "xml",
                 "epub", "zip", "msg", "png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif",
                 "webp", "wav", "mp3", "m4a"]
BATCH_FORMATS = ["pdf", "docx", "pptx", "xlsx", "html", "epub", "png", "jpg", "jpeg",
                 "tiff", "tif", "webp", "gif", "bmp"]
IMAGE_FORMATS = ["png", "jpg", "jpeg", "tiff", "tif", "webp", "gif", "bmp"]
ROUTED_HEAVY_FORMATS = ["pdf", "png", "jpg", "jpeg", "tiff", "tif", "webp", "gif", "bmp"]

# Folders a scan never enters, and the default scan depth.
CLUTTER_FOLDERS = ["node_modules", ".git", "converted", "marker-output", "markitdown-output"]
DEFAULT_DEPTH = 3

# Sidecar names.
SIDECAR_NAME = "provenance.json"
SIDECAR_SUFFIX = ".provenance.json"
PROVENANCE_SCHEMA = "vellum/provenance/1"
BENCH_SCHEMA = "vellum/bench/2"

# Option names and types, output formats, page-range limits.
OPTION_TYPES = {"output_format": "STRING", "output_dir": "STRING", "use_llm": "BOOLEAN",
                "force_ocr": "BOOLEAN", "page_range": "STRING"}
OUTPUT_FORMATS = ["markdown", "json", "html", "chunks"]
PAGE_RANGE_MAX_PAGES = 2000
PAGE_RANGE_MAX_INDEX = 100000

# Services a deployment may configure, their default endpoints, and
# the key a client must send to a compatible server that ignores it.
MODEL_SERVICES = {
    "ollama": "marker.services.ollama.OllamaService",
    "openai": "marker.services.openai.OpenAIService",
}
MODEL_SERVICE_URLS = {
    "ollama": "http://localhost:11434",
    "openai": "http://localhost:8080/v1",
}
PLACEHOLDER_KEY = "not-needed"

# Job sizing in seconds, result lifetime, text-layer rule.
JOB_TIMEOUT_BASE = 1800
JOB_TIMEOUT_PER_PAGE = 180
JOB_TIMEOUT_UNKNOWN = 21600
RESULT_TTL = 86400
TEXT_LAYER_MIN_CHARS = 50
SAMPLE_PAGES = 3

# Redaction.
REDACTED = "[redacted]"
SECRET_NAME = "(?i)key|token|secret|password|credential"
URL_USERINFO = r"([A-Za-z][A-Za-z0-9+.-]*://)[^/?#\s]*@"

# Exit codes and their severity, worst last.
EXIT_OK, EXIT_FAILED, EXIT_NO_INPUT, EXIT_NOTHING = 0, 1, 2, 3
EXIT_SEVERITY = [EXIT_OK, EXIT_NOTHING, EXIT_NO_INPUT, EXIT_FAILED]

# Roots a job may read from and write to, and the one job function.
INPUT_ROOT = "/data/input"
OUTPUT_ROOT = "/data/output"
JOB_FUNCTION = "convert_document"
CALLER_ERROR = "conversion failed — see worker logs"

# Code points Python's str.strip removes.
WHITESPACE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760,
                               *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
