"""Thresholds, lookup tables, phrases and word lists.

The numbers and words in this module are data, not logic. They are stated as they have to be for the
scores to come out right; every operator takes them as a parameter so that a user can replace them.
"""

from __future__ import annotations

# Characters that count as white space when lines are stripped and split into words.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters: Java's ``\s`` with ``(?U)`` is one look at a character's type, a list of ranges one test each.
WORD_BREAK = r"(?U)[\s\x1c-\x1f]+"

# A score below the ceiling gets the label, anything above gets CRITICAL.
VULNERABILITY_TIERS = {"LOW": 20, "MEDIUM": 50, "HIGH": 75}
CONTAMINATION_TIERS = {"LOW": 15, "MEDIUM": 40, "HIGH": 70}
FAIRNESS_TIERS = {"LOW": 20, "MEDIUM": 45, "HIGH": 70}
OVERALL_TIERS = {"LOW": 20, "MEDIUM": 45, "HIGH": 70}
# Tokens per parameter, from the scarcest to the most plentiful.
MEMORIZATION_TIERS = {"CRITICAL": 1, "HIGH": 10, "MEDIUM": 40, "LOW": 100}

# Fixed values: (name, least lines, most lines, least mean length, most mean length) of public test sets.
BENCHMARK_PRINTS = [
    ("MMLU", 14000, 16000, 80, 200),
    ("HellaSwag", 9000, 11000, 100, 250),
    ("TruthfulQA", 700, 900, 50, 150),
    ("GSM8K", 1300, 1400, 100, 300),
    ("HumanEval", 150, 175, 200, 600),
    ("SQuAD", 10000, 12000, 100, 400),
    ("GLUE_SST2", 67000, 70000, 50, 150),
    ("ImageNet_test", 0, 0, 0, 0),
]

# Phrases typical of benchmark items.
BENCHMARK_PHRASES = [
    "the following question asks about",
    "choose the correct answer from the options",
    "which of the following is true about",
    "according to the passage above",
    "what is the capital of",
    "def solution(input_str):",
    "complete the following sentence by choosing",
    "read the passage and answer the question",
    "the answer to the above question is",
]

# Model parameters in millions by (model size, AI type).
MODEL_PARAMS_M = {
    "Small": {"NLP": 10, "Computer Vision": 5, "Recommendation": 2, "Speech": 10},
    "Medium": {"NLP": 125, "Computer Vision": 50, "Recommendation": 20, "Speech": 74},
    "Large": {"NLP": 7000, "Computer Vision": 300, "Recommendation": 100, "Speech": 1500},
}

# Fixed values: (GPU, peak FP16 TFLOPS, dollars per hour).
GPUS = [
    ("A100", 312, 3.0),
    ("H100", 990, 8.0),
    ("V100", 125, 2.5),
    ("A10G", 71, 1.5),
    ("T4", 65, 0.5),
]
GPU_UTILIZATION = 0.4

# Data kinds each AI type accepts.
ACCEPTED_KINDS = {
    "NLP": ["text"],
    "Computer Vision": ["image"],
    "Recommendation": ["tabular"],
    "Speech": ["text", "audio"],
    "General": ["text", "tabular", "image"],
}
# Tasks each architecture suits.
ARCHITECTURE_TASKS = {
    "Transformer": ["Classification", "Generation", "Detection"],
    "CNN": ["Classification", "Detection"],
    "RNN": ["Generation", "Classification"],
    "MoE": ["Generation", "Classification"],
}
# Fixed values: (rows, tokens) needed per model size.
SIZE_NEEDS = {
    "Small": (1_000, 500_000),
    "Medium": (50_000, 25_000_000),
    "Large": (1_000_000, 500_000_000),
}
# Quality score a domain asks for; other domains ask for the default.
DOMAIN_QUALITY = {"Healthcare": 80, "Finance": 75, "Social Media": 55, "General": 60}
DEFAULT_DOMAIN_QUALITY = 60

# Rows recommended per column group.
GROUP_ROWS = {
    "Healthcare": 50_000,
    "Finance": 100_000,
    "Social Media": 500_000,
    "Computer Vision": 10_000,
    "Music/Audio": 10_000,
    "E-Commerce": 50_000,
    "NLP/Text": 100_000,
    "General": 10_000,
}

# Domains that tolerate each other.
RELATED_DOMAINS = {
    "Healthcare": ["Healthcare"],
    "Finance": ["Finance", "E-Commerce"],
    "Social Media": ["Social Media", "NLP/Text"],
    "Computer Vision": ["Computer Vision"],
    "Music/Audio": ["Music/Audio"],
    "E-Commerce": ["E-Commerce", "Finance"],
    "NLP/Text": ["NLP/Text", "Social Media"],
}

# Per domain (weight, words found in column names, words found as values).
DOMAIN_SIGNATURES = {
    "Healthcare": (
        1.4,
        [
            "patient", "diagnosis", "symptom", "disease", "condition", "treatment", "medication", "drug",
            "dose", "dosage", "prescription", "icd", "cpt", "blood", "glucose", "cholesterol", "bmi",
            "weight", "height", "age", "gender", "sex", "vital", "pulse", "temperature", "oxygen",
            "systolic", "diastolic", "hemoglobin", "creatinine", "lab", "test", "result", "hospital",
            "clinic", "ward", "surgery", "procedure",
        ],
        [
            "cancer", "diabetes", "hypertension", "asthma", "stroke", "healthy", "positive", "negative",
            "mg", "mmhg", "bpm", "cm", "kg", "male", "female",
        ],
    ),
    "Finance": (
        1.4,
        [
            "transaction", "amount", "balance", "credit", "debit", "account", "payment", "merchant", "fraud",
            "currency", "bank", "loan", "interest", "rate", "invest", "portfolio", "stock", "equity", "bond",
            "revenue", "profit", "loss", "tax", "invoice", "fee", "charge", "transfer", "deposit",
            "withdrawal", "card", "iban", "swift", "ticker", "price", "close", "open", "volume", "market",
        ],
        [
            "usd", "eur", "gbp", "jpy", "inr", "ngn", "fraud", "legitimate", "buy", "sell", "debit",
            "credit", "approved", "declined", "visa", "mastercard", "amex",
        ],
    ),
    "Social Media": (
        1.3,
        [
            "tweet", "post", "like", "share", "retweet", "follower", "following", "hashtag", "mention",
            "comment", "reply", "engagement", "impression", "reach", "sentiment", "user", "username",
            "handle", "bio", "profile", "platform", "content", "viral", "trending", "influence",
            "subscriber",
        ],
        [
            "positive", "negative", "neutral", "twitter", "instagram", "facebook", "tiktok", "reddit",
            "linkedin", "youtube", "love", "hate", "awesome",
        ],
    ),
    "Computer Vision": (
        1.3,
        [
            "image", "img", "pixel", "width", "height", "channel", "class", "label", "bbox", "annotation",
            "bounding", "split", "train", "val", "test", "augment", "filename", "path", "format", "jpeg",
            "png", "resolution", "brightness", "contrast", "blur", "saturation", "hue", "mask", "segment",
            "detection",
        ],
        [
            "jpg", "jpeg", "png", "bmp", "webp", "svg", "train", "val", "test", "cat", "dog", "car",
            "person", "bird", "object", "background",
        ],
    ),
    "Music/Audio": (
        1.3,
        [
            "song", "track", "artist", "album", "genre", "tempo", "bpm", "key", "chord", "note", "frequency",
            "pitch", "melody", "rhythm", "beat", "measure", "bar", "time_signature", "lyric", "vocal",
            "instrument", "midi", "audio", "waveform", "sample", "danceability", "energy", "valence",
            "acousticness", "loudness", "mode", "duration", "liveness", "speechiness", "instrumentalness",
        ],
        [
            "major", "minor", "jazz", "rock", "pop", "classical", "blues", "electronic", "hip-hop", "reggae",
            "folk", "country", "metal", "bpm", "hz", "db",
        ],
    ),
    "E-Commerce": (
        1.2,
        [
            "product", "order", "cart", "customer", "purchase", "price", "quantity", "category", "sku",
            "inventory", "stock", "shipping", "delivery", "review", "rating", "seller", "buyer", "discount",
            "coupon", "return", "refund", "checkout", "wishlist", "recommendation", "sale", "item",
            "description",
        ],
        [
            "in_stock", "out_of_stock", "pending", "shipped", "delivered", "cancelled", "5_star", "4_star",
            "electronics", "clothing", "books", "furniture",
        ],
    ),
    "NLP/Text": (
        1.1,
        [
            "text", "sentence", "token", "word", "corpus", "document", "abstract", "content", "review",
            "paragraph", "sequence", "input", "output", "label", "class", "language", "translation",
            "summary", "source", "target", "vocab", "embedding", "tfidf", "ngram", "pos", "ner", "entity",
            "relation",
        ],
        [
            "positive", "negative", "neutral", "english", "french", "spanish", "german", "entailment",
            "contradiction", "true", "false",
        ],
    ),
}
FALLBACK_DOMAIN = "General"
DOMAINS = [*DOMAIN_SIGNATURES, FALLBACK_DOMAIN]

# What a scenario may name.
SCENARIO_CHOICES = {
    "ai_type": ["NLP", "Computer Vision", "Recommendation", "Speech", "General"],
    "model_size": ["Small", "Medium", "Large"],
    "architecture": ["Transformer", "CNN", "RNN", "MoE"],
    "domain": DOMAINS,
    "task_type": ["Classification", "Generation", "Detection", "Recommendation"],
}
SCENARIO_DEFAULTS = {
    "ai_type": "NLP",
    "model_size": "Medium",
    "architecture": "Transformer",
    "domain": "General",
    "task_type": "Classification",
    "param_count_millions": 7000.0,
}

# Sample-size rules.
MIN_SAMPLE = 1_000
MAX_SAMPLE = 1_000_000
SAMPLE_SHARES = [
    (10_000, 1.0),
    (100_000, 0.5),
    (1_000_000, 0.2),
    (10_000_000, 0.05),
]
LAST_SAMPLE_SHARE = 0.01

# Two-sided 95 % normal quantile, score variance and assumed sample size of a risk interval.
Z_95 = 1.959963984540054
RISK_VARIANCE = 100.0
RISK_SAMPLE = 1000
