"""Word lists and patterns of the text rules. All of these are fixed values."""

LABEL_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall", "must", "can", "need", "to", "of",
    "in", "on", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "from", "up", "down", "out", "off", "over", "under", "again", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "but", "and", "or", "it",
    "its", "as", "this", "that", "these", "those", "which", "who", "system", "provide", "ensure", "support", "include", "allow",
    "enable", "within", "without", "using", "based", "per", "via", "including", "while", "also", "any", "applicable", "defined", "minimum",
    "maximum", "least", "greater", "less", "equal", "type", "value", "number", "set", "meet", "maintain", "required", "requirement",
]
REQUIREMENT_STOPWORDS = [
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "being", "by", "can", "could", "do",
    "does", "during", "each", "for", "from", "had", "has", "have", "how", "in", "include", "includes", "including", "into",
    "is", "it", "its", "may", "must", "of", "on", "or", "provide", "provides", "requirement", "requirements", "required", "shall",
    "should", "support", "supports", "such", "system", "that", "the", "these", "this", "to", "will", "with",
]
SEQUENTIAL_CUES = ["after", "once", "upon", "following", "subsequent to", "prior to", "before", "until", "as soon as", "in response to", "when ", "whenever"]
HIERARCHICAL_CUES = [
    "in accordance with", "as defined in", "as specified in", "subject to", "comply with", "conform to", "according to", "consistent with",
    "as required by", "in compliance with", "as described in",
]
OUTPUT_VERBS = [
    "provide", "generate", "produce", "output", "compute", "calculate", "emit", "return", "report", "transmit", "send", "create", "store", "record", "log", "measure", "detect", "raise", "issue",
]
INPUT_VERBS = ["receive", "require", "use", "read", "accept", "consume", "depend", "retrieve", "obtain", "process", "monitor", "respond to", "trigger on", "based on", "derived from"]
COLUMN_VARIANTS = {
    "id": ["id", "req_id", "requirement_id", "req id", "identifier"],
    "text": ["text", "requirement", "description", "requirement text", "req text", "content", "shall"],
    "module": ["module", "subsystem", "category", "domain", "system"],
    "section": ["section", "chapter", "area", "group", "heading"],
}
#: Cells that the delimited reader takes as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
REQ_ID = r"\b(?:REQ|SR|FR|SYS|R)[-_ ]?\d{1,5}\b"
LABEL_TOKEN = r"\b[a-zA-Z][a-zA-Z0-9\-]{2,}\b"
SALIENT_TOKEN = r"[a-zA-Z][a-zA-Z0-9\-]{2,}"
VOCABULARY_TOKEN = r"[a-z][a-z0-9-]{1,}"
QUALITY_TOKEN = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
NUMBER = r"(?<![a-z0-9])\d+(?:\.\d+)?(?:%|ms|s|sec|seconds|m|kg|v)?(?![a-z0-9])"
COMPONENT = r"\b(?:[A-Z][A-Za-z0-9-]{2,}|[A-Z]{2,}(?:-[A-Z0-9]+)*)\b"
COMPONENT_PARTS = ["module", "service", "api", "sensor", "controller"]
OBLIGATIONS = ["may", "should", "shall", "must"]
RELATION_KEYWORDS = {"data": "deriveReqt", "hierarchical": "deriveReqt", "sequential": "trace", "reference": "trace"}

#: Sentences of the suggestions and conflicts that must read alike.
SPLIT_SHOWN = 'Cluster "%s" shows a bimodal distribution (bimodality score: %.3f, BIC improvement: %.1f).'
SPLIT_SIZES = "The two identified sub-groups contain %d and %d requirements respectively."
SPLIT_SPREAD = "The cluster has high internal spread (%.3f), supporting the case for splitting."
SPLIT_END = "Splitting would create more focused clusters with tighter semantic coherence."
SUMMARY_ABOUT = "covers requirements related to "
SUMMARY_PLAIN = "contains related requirements"
SUMMARY_TEXTS = "Representative requirements include: "
CONFLICT_MESSAGE = "Requirements %s and %s have a cannot-link constraint but are transitively grouped together by must-link corrections."
