"""The vocabulary, quotas, prompts and limits that results must agree with.

Every operator takes these as parameters; nothing outside this module depends on a particular class list.
"""

from __future__ import annotations

# File name extensions that count as images, and as annotation files.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
ANNOTATION_EXTENSIONS = (".csv", ".tsv", ".json", ".jsonl", ".txt")
IGNORED_ANNOTATION_STEMS = ("readme", "license", "requirements")

# The classes a dataset must contain, and the known split names, in order of precedence.
TARGET_CATEGORIES = ("healthy", "active_tb", "sick_but_non_tb")
SPLITS = ("train", "val", "test")

# The spellings of each class; the order of the classes settles ties.
CATEGORY_ALIASES = {
    "healthy": ("healthy", "health", "normal", "no_tb", "no_tuberculosis"),
    "active_tb": ("active_tb", "activetb", "active", "tb", "tuberculosis"),
    "latent_tb": ("latent_tb", "latenttb", "latent"),
    "sick_but_non_tb": (
        "sick_but_non_tb",
        "sickbutnontb",
        "sick_non_tb",
        "sicknontb",
        "sick_but_non-tb",
        "non_tb",
        "nontb",
        "sick",
    ),
}

# Whole-stem file name patterns that name a class.
STEM_PATTERNS = (("h[0-9]+", "healthy"), ("tb[0-9]+", "active_tb"), ("s[0-9]+", "sick_but_non_tb"))

# Header names of annotation files, in the order in which they are tried.
IMAGE_COLUMNS = ("image_path", "image", "img_path", "img", "file_name", "filename", "file", "path", "name")
LABEL_COLUMNS = ("label", "labels", "class", "category", "finding", "target")
SPLIT_COLUMNS = ("split", "set", "subset", "phase")
JSON_ROW_KEYS = ("annotations", "images", "data", "records", "items")

# Classes a model is asked to choose from (ties go to the first) and the positive group.
CLASS_LABELS = ("active_tb", "healthy", "sick_but_non_tb")
POSITIVE_LABELS = ("active_tb", "latent_tb")

# The answer line and the prompt of a conversation record.
ANSWER_PREFIX = "Classification: "
PROMPT = (
    "Analyze this chest X-ray image for tuberculosis screening. "
    "Use exactly one of these labels: active_tb, healthy, sick_but_non_tb. "
    "Return only the classification line in the form `Classification: <label>`."
)
SAMPLE_ORDER = ("healthy", "active_tb", "sick_but_non_tb")

# Rows per split and class.
SPLIT_QUOTAS = {
    "train": {"active_tb": 600, "healthy": 3000, "sick_but_non_tb": 3000},
    "val": {"active_tb": 200, "healthy": 800, "sick_but_non_tb": 800},
}
FULL_VALIDATION_SIZE = 1800
CALIBRATION_SIZE = 128

# Token masking, batches and image size.
IGNORE_INDEX = -100
REQUIRED_BATCH_FIELDS = (
    "input_ids",
    "attention_mask",
    "mm_token_type_ids",
    "pixel_values",
    "image_grid_thw",
    "labels",
)
IMAGE_SIZE = (512, 512)

# Sampler exponents by strategy.
SAMPLER_EXPONENTS = {"balanced": 1.0, "soft-balanced": 0.5}

# Published metrics that later runs are compared with, and the tolerances of the comparisons.
FULL_PRECISION_BASELINE = {
    "accuracy": 0.987222,
    "macro_f1": 0.978787,
    "per_class_f1": {"active_tb": 0.953317, "healthy": 0.996881, "sick_but_non_tb": 0.986164},
}
EARLIER_BASELINE = {
    "accuracy": 0.942222,
    "macro_f1": 0.910004,
    "per_class_f1": {"active_tb": 0.809195, "healthy": 0.954399, "sick_but_non_tb": 0.966418},
}
MAX_MACRO_F1_DROP = 0.02
ABLATION_MARGIN = 0.005
ABLATION_DROP_TOLERANCE = {"active_tb": 0.04, "healthy": 0.02, "sick_but_non_tb": 0.02}

# Gates by the names they are chosen by, with the names that their results carry.
GATE_NAMES = {"run3-diagnostic": "run3_diagnostic", "run4-diagnostic": "run4_diagnostic", "run3-full": "run3_full"}

# Gate limits.
MONOPOLY_SHARE = 0.80
MINIMUM_PREDICTIONS = 50
FULL_GATE = {"macro_f1": 0.30, "accuracy": 0.50, "prediction_range": (400, 1000)}

# Heat map clipping and contrast.
CLIP_PERCENTILES = (55.0, 99.5)
GAMMA = 0.8
SALIENCY_EPSILON = 1e-8
