"""Fixed values.

Everything in this module must keep exactly these values for results to agree with
published behaviour: limits, lookup tables, thresholds, word lists and fitted
coefficients. No logic lives here.
"""

# --- limits -----------------------------------------------------------------
MAX_FILE_BYTES = 33_554_432  # 32 MiB
MAX_PIXELS = 100_000_000
MAX_DECOMPRESSED_BYTES = 536_870_912  # 512 MiB
MAX_FRAMES = 500
MAX_REDIRECTS = 5
HEADER_ONLY_MIN_BYTES = 1_048_576
THUMBNAIL_MIN_BYTES = 10_485_760
EXACT_PIXELS = 150_000
EXACT_FILE_BYTES = 1_000_000
LARGE_PNG_PIXELS = 4_000_000
LARGE_GIF_PIXEL_FRAMES = 100_000_000
TIFF_PARALLEL_PIXELS = 5_000_000
JPEG_HEAD_BYTES = 65_536
JPEG_MAX_MARKERS = 256
JPEG_MAX_DQT_BYTES = 4096
PNG_MAX_INPUT_BPP = 64.0
JPEG_MAX_INPUT_BPP = 24.0
MIN_NSE = 0.85

# --- formats ----------------------------------------------------------------
MIME_TYPES = {
    "png": "image/png",
    "apng": "image/apng",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "svgz": "image/svg+xml",
    "avif": "image/avif",
    "heic": "image/heic",
    "tiff": "image/tiff",
    "bmp": "image/bmp",
    "jxl": "image/jxl",
}
LOSSY_FORMATS = ("avif", "heic", "jpeg", "jxl", "webp")
LOSSLESS_FORMATS = ("apng", "bmp", "gif", "png", "svg", "svgz", "tiff")
VECTOR_FORMATS = ("svg", "svgz")

MEMORY_MULTIPLIERS = {
    "png": 5,
    "apng": 5,
    "jpeg": 4,
    "webp": 4,
    "gif": 2,
    "svg": 1,
    "svgz": 1,
    "avif": 4,
    "heic": 4,
    "tiff": 6,
    "bmp": 3,
    "jxl": 4,
}

# Bytes per pixel and bits per channel by pixel mode.
MODE_BYTES = {
    "1": 1, "L": 1, "P": 1, "RGB": 3, "RGBA": 4, "CMYK": 4, "YCbCr": 3, "LAB": 3,
    "I": 4, "F": 4, "LA": 2, "PA": 2, "RGBa": 4, "I;16": 2,
}
MODE_BITS = {"1": 1, "L": 8, "P": 8, "RGB": 8, "RGBA": 8, "LA": 8, "I": 32, "F": 32, "I;16": 16}
MODE_COLOR_TYPE = {
    "RGB": "rgb", "RGBA": "rgba", "P": "palette", "L": "grayscale", "LA": "grayscale", "1": "grayscale",
}

# --- size buckets: [low, high), the last is open ------------------------------
BUCKETS = (
    ("tiny", 0, 10_240),
    ("small", 10_240, 102_400),
    ("medium", 102_400, 1_048_576),
    ("large", 1_048_576, 5_242_880),
    ("xlarge", 5_242_880, None),
)

# --- presets: name, quality, png_lossy -----------------------------------------
PRESETS = (("high", 40, True), ("medium", 60, True), ("low", 75, False))
DEFAULT_QUALITY = 80
TRAINING_QUALITIES = (40, 60, 75, 85)
MIN_TRAINING_ROWS = 60

# --- error codes: code, HTTP status --------------------------------------------
ERROR_STATUS = {"file_too_large": 413, "unsupported_format": 415, "image_too_large": 413}

# --- benchmark thresholds ---------------------------------------------------------
SSIM_FLOOR = {"high": 0.95, "medium": 0.97, "low": 0.99}
SSIM_FLOOR_DEFAULT = 0.97
WARN_SSIM_FACTOR = 0.98
LATENCY_SLO_MS = {"tiny": 100, "small": 500, "medium": 2000, "large": 8000, "xlarge": 20000}
LATENCY_SLO_DEFAULT_MS = 2000
LATENCY_RELAXED_FORMATS = ("heic", "jxl")
LATENCY_RELAXED_BUCKETS = ("large", "xlarge")
LATENCY_RELAX = 1.5
SIZE_ERROR_P95_PCT = 15.0
LABEL_SEVERITY = {
    "improvement": 0,
    "ok": 1,
    "below_threshold": 1,
    "noise_floor_ok": 1,
    "noise_floor_regression": 2,
    "significant": 3,
}

# --- URL screening -------------------------------------------------------------
BLOCKED_HOSTS = ("metadata.google.internal", "metadata.google.internal.")
BLOCKED_NETWORKS = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "169.254.0.0/16",
    "127.0.0.0/8",
    "0.0.0.0/8",
    "::1/128",
    "fc00::/7",
)

# --- markup screening ------------------------------------------------------------
DANGEROUS_ELEMENTS = ("script", "foreignobject")
EVENT_HANDLERS = (
    "onload", "onerror", "onclick", "onmouseover", "onmouseout", "onmousedown", "onmouseup",
    "onmousemove", "onfocus", "onblur", "onchange", "onsubmit", "onreset", "onselect", "onkeydown",
    "onkeypress", "onkeyup", "onabort", "onactivate", "onbegin", "onend", "onrepeat", "onunload",
    "onscroll", "onresize", "oninput", "onanimationstart", "onanimationend",
    "onanimationiteration", "ontransitionend",
)
PII_PATTERN = "[/@]|http"

# --- JPEG Annex K quantization tables at quality 50, zigzag order -------------------
ANNEX_K_LUMA = (
    16, 11, 12, 14, 12, 10, 16, 14, 13, 14, 18, 17, 16, 19, 24, 40,
    26, 24, 22, 22, 24, 49, 35, 37, 29, 40, 58, 51, 61, 60, 57, 51,
    56, 55, 64, 72, 92, 78, 64, 68, 87, 69, 55, 56, 80, 109, 81, 87,
    95, 98, 103, 104, 103, 62, 77, 113, 121, 112, 100, 120, 92, 101, 103, 99,
)
ANNEX_K_CHROMA = (
    17, 18, 18, 24, 21, 24, 47, 26, 26, 47, 99, 66, 56, 66, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)

# --- fitted savings models -------------------------------------------------------
PNG_HEADER_MODEL = {
    "model_version": 1,
    "format": "png_header",
    "features": ["has_alpha", "quality", "log10_orig_pixels", "input_bpp"],
    "scaler": {
        "mean": [0.1794871794871795, 65.0, 5.7078606486011925, 9.529372367982205],
        "scale": [0.3837597319768143, 16.95582495781317, 0.4241477394511103, 5.719141017544482],
    },
    "coefficients": {
        "intercept": 2.0622577319071165,
        "betas": [0.07137803161837566, 0.28549637016483964, -0.09806899939208313, 1.3401682715027379],
        "knot_q50_beta": 0.0034329028864743525,
        "knot_q70_beta": 0.0249821054892282,
    },
    "knots": {"knot_q50_beta": ("quality", 50.0), "knot_q70_beta": ("quality", 70.0)},
}
PNG_THUMBNAIL_MODEL = {
    "model_version": 2,
    "format": "png",
    "features": [
        "has_alpha", "log10_unique_colors", "mean_sobel", "edge_density",
        "quality", "log10_orig_pixels", "input_bpp",
    ],
    "scaler": {
        "mean": [
            0.1794871794871795, 3.352724888271933, 119.9057269952236, 0.638671875,
            65.0, 5.707860648601195, 9.529372367982202,
        ],
        "scale": [
            0.3837597319768145, 0.3131453373818386, 61.96075319726212, 0.17581333834778157,
            16.95582495781317, 0.4241477394511104, 5.719141017544482,
        ],
    },
    "coefficients": {
        "intercept": 1.7768917282230474,
        "betas": [
            0.09218017890142713, -0.22093042421974662, -0.10829938715832696, 0.2865850205155974,
            0.2854963701648385, -0.13797730913264222, 1.137954692743028,
        ],
        "knot_beta": 1.8527342989171187,
        "knot_q50_beta": 0.00343290288647406,
        "knot_q70_beta": 0.024982105489228273,
    },
    "knots": {
        "knot_beta": ("log10_unique_colors", 3.3),
        "knot_q50_beta": ("quality", 50.0),
        "knot_q70_beta": ("quality", 70.0),
    },
}
JPEG_HEADER_MODEL = {
    "model_version": 1,
    "format": "jpeg_header",
    "features": [
        "target_quality", "source_quality", "nse", "subsampling_444", "subsampling_422",
        "subsampling_420", "progressive", "log10_orig_pixels", "input_bpp", "mean_dqt_luma",
        "std_dqt_luma", "mean_dqt_chroma", "std_dqt_chroma",
    ],
    "scaler": {
        "mean": [
            65.0, 85.0, 1.0, 0.0, 0.0, 1.0, 0.0, 5.99688242426815, 1.536421795622969, 17.328125,
            10.38322011327096, 26.03125, 8.30943000356386,
        ],
        "scale": [
            16.95582495781317, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5418406041178033,
            0.6120155100377795, 1.0, 1.0, 1.0, 1.0,
        ],
    },
    "coefficients": {
        "intercept": 1.0410048334625994,
        "betas": [
            0.3523683895538571, -2.7755575615628914e-17, 0.0, 0.0, 0.0, 0.0, 0.0,
            -0.003889771497614837, 0.43660258180345674, 0.0, 1.4660944651239884e-14, 0.0,
            -1.8412576270740373e-14,
        ],
    },
    "knots": {},
}
MODEL_VERSIONS = {"png": 2, "png_header": 1, "jpeg_header": 1}
MODEL_MAX_INTERCEPT = 1000.0
MODEL_MAX_BETA = 100.0
