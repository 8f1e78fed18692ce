"""Fixed values of the rules: hosts, weights, words and patterns.

All tables here are small constants (well under 200 entries); results depend on their exact content.
"""

# White space as Unicode text tools see it, as a character list and as a regex class.
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NOT_SPACE = r"[^\p{IsWhite_Space}\x1c-\x1f]"

# Additive link score, matched as substrings of host + path.
HOST_WEIGHTS = [
    ("huggingface.co/datasets", 10),
    ("zenodo.org/record", 9),
    ("kaggle.com/datasets", 8),
    ("figshare.com", 8),
    ("dataverse.org", 8),
    ("osf.io", 7),
    ("archive.org/details", 6),
    ("datahub.io", 6),
    ("storage.googleapis.com", 5),
    ("drive.google.com", 4),
    ("raw.githubusercontent.com", 3),
]
GITHUB_RELEASE_WEIGHT = 6
GITHUB_DATA_DIR_WEIGHT = 5
HOST_PENALTIES = [
    ("arxiv.org", -10),
    ("doi.org", -8),
    ("dx.doi.org", -8),
    ("acm.org", -8),
    ("ieeexplore.ieee.org", -8),
    ("scholar.google", -10),
    ("researchgate.net", -6),
    ("medium.com", -6),
]
REPO_ROOT_PENALTY = -4
PATH_WEIGHTS = [
    ("/dataset", 3),
    ("/datasets", 3),
    ("/data", 2),
    ("/download", 2),
    ("/files", 2),
    ("/record", 2),
    ("/releases", 2),
    ("/blob/main/data", 2),
    ("/tree/main/data", 2),
]
# Only the first matching ending counts.
FILE_ENDING_WEIGHTS = [
    (".csv", 6),
    (".tsv", 6),
    (".json", 6),
    (".parquet", 6),
    (".zip", 5),
    (".tar", 5),
    (".tar.gz", 5),
    (".tgz", 5),
    (".xz", 5),
    (".7z", 5),
    (".rar", 4),
]
POSITIVE_WORDS = [
    "dataset", "data availability", "we release", "our dataset", "available at",
    "we present", "we introduce a dataset", "benchmark", "corpus",
]
NEGATIVE_WORDS = [
    "code", "source code", "implementation", "paper", "supplementary material",
    "bibtex", "project page", "homepage", "website",
]
NEGATIVE_PHRASES = [("we evaluate on", "dataset"), ("we use", "dataset")]
WORD_STEP, POSITIVE_CAP, NEGATIVE_CAP, PHRASE_PENALTY = 2, 8, 6, -3

# Hosts that win the primary pick when they are among the best five.
PREFERRED_HOSTS = [
    "huggingface.co/datasets", "zenodo.org/record", "kaggle.com/datasets", "figshare.com",
    "dataverse.org", "osf.io", "archive.org/details", "datahub.io", "storage.googleapis.com",
    "drive.google.com", "raw.githubusercontent.com",
]
# Tie-break classes of the rule pick, best first.
HOST_CLASSES = [
    (5, ["huggingface.co/datasets"]),
    (4, ["zenodo.org/record", "kaggle.com/datasets", "figshare.com", "dataverse.org"]),
]
HOST_CLASS_GITHUB, HOST_CLASS_BUCKET, HOST_CLASS_DRIVE = 3, 2, 1
DIRECT_SCORE, LEAD_SCORE, LEAD_GAP, MIN_PICK_SCORE = 22, 16, 5, 15

# Structural test and the older additive score.
DATA_HOSTS = [
    "huggingface.co/datasets", "zenodo.org/record", "figshare.com", "osf.io", "kaggle.com/datasets",
    "dataverse.org", "datahub.io", "archive.org/details", "drive.google.com",
    "storage.googleapis.com", "opendatasoft.com",
]
DATA_PATHS = [
    "/dataset", "/datasets", "/download", "/files", "/record",
    "/releases", "/data", "/blob/main/data", "/tree/main/data",
]
DATA_ENDINGS = [".zip", ".tar", ".tar.gz", ".tgz", ".xz", ".7z", ".rar", ".csv", ".tsv", ".json", ".parquet"]
REJECTED_HOSTS = [
    "arxiv.org", "scholar.google", "dx.doi.org", "doi.org", "acm.org", "ieeexplore.ieee.org",
    "statista.com", "tvisioninsights.com", "4open.science", "medium.com", "researchgate.net",
]
CONTEXT_WORDS = [
    "dataset", "data availability", "download", "corpus", "benchmark",
    "we release", "available at", "provided at",
]
CONTEXT_ANTI_WORDS = ["code", "implementation", "paper", "supplementary material", "bibtex"]

# Hosts of the older allow-lists and the domain order of the best link in a text.
ALLOWED_HOSTS = [
    "kaggle.com", "zenodo.org", "figshare.com", "data.mendeley.com", "huggingface.co", "github.com",
]
DOMAIN_ORDER = [
    "huggingface.co/datasets", "kaggle.com/datasets", "zenodo.org/record", "zenodo.org",
    "figshare.com", "osf.io", "data.mendeley.com", "paperswithcode.com/datasets",
    "datahub.io", "doi.org", "storage.googleapis.com", "drive.google.com",
    "cloud.google.com/storage", "github.com",
]

# Keyword heuristic of the link classifier.
DATASET_CLUES = [
    " dataset", "data set", "corpus", "benchmark", "annotations", "download data",
    "数据集", "标注", "下载数据", "doi", "zenodo", "figshare", "mendeley",
    "huggingface.co/datasets", "osf.io", "openml", "dataverse",
]
CODE_CLUES = [
    " github", "source code", "implementation", "repo", "repository",
    "代码", "实现", "huggingface.co", "gitlab",
]
WHY_KEYWORD, WHY_NONE, WHY_CONTEXT = "关键词触发", "无明显线索", "上下文判别"

# Abbreviations whose dots end no sentence.
ABBREVIATIONS = [
    "e.g.", "i.e.", "etc.", "vs.", "fig.", "Fig.", "al.", "cf.", "v.", "Mr.", "Mrs.", "Ms.",
    "Dr.", "Prof.", "Sr.", "Jr.", "Co.", "Ltd.", "St.", "Ph.D.", "U.S.", "U.K.", "U.N.",
]

# LaTeX constructs removed or unwrapped before scoring.
TEX_BLOCKS = ["equation", "align", "gather", "multline", "figure", "table"]
TEX_REFERENCES = ["cite", "Cite", "ref", "eqref", "autoref", "cref", "Cref"]
TEX_DROPPED = ["url", "path", "footnote"]
TEX_INCLUDES = ["input", "includegraphics"]
TEX_FORMATS = ["emph", "textbf", "textit", "mathbf", "mathrm", "textrm", "texttt", "underline"]
TEX_CHARACTERS = [
    ("\\%", "%"), ("\\_", "_"), ("\\&", "&"), ("\\#", "#"),
    ("``", "“"), ("''", "”"), ("---", "—"), ("--", "–"), ("~", " "),
]
TEX_GREEK = [
    "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda",
    "mu", "nu", "xi", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega",
]
TEX_MATH = [
    "frac", "sum", "int", "prod", "lim", "log", "sin", "cos", "tan",
    "mathbf", "mathbb", "mathcal", "mathrm", "left", "right",
]
# Links in text and LaTeX.
HREF_PATTERN = r"\\href\{([^}]+)\}\{([^}]*)\}"
URL_COMMAND_PATTERN = r"\\url\{([^}]+)\}"
SECTION_PATTERN = r"\\(?:sub)*section\*?\{([^}]*)\}"
BARE_LINK_PATTERN = rf"(?i)((?:https?://|ftp://)[^\s<>{{}}|\^\[\]`\\)\"]+)"
BARE_CONTEXT_LINK_PATTERN = r"(?i)(https?://[^\s{}\\]+)"
TEXT_LINK_PATTERN = r"(?i)https?://[^\s<>\])\"}]+"
SUMMARY_LINK_PATTERN = r"https?://[^\s)\]]+"

# Signs of code, logs and prompts in a summary.
LEAK_PATTERN = (
    r"(?imd)(\bEVIDENCE\b|\bOUTPUT\s*FORMAT\b|\{context\}|\bTool Response\b|\bAgent\b|\bAPI[-\s]|```|^>>|^#+\s)"
)
ONE_LINE_JSON_PATTERN = r"^\s*[{\[][^\n]*[\]}]"
CAPS_HEADER_PATTERN = r"^[A-Z ][A-Z0-9 \-:_]{12,}\n?\z"
SYMBOL_CHARS = "{}[]()<>=_`#*~^$\\|;"
ROLE_TAG_PATTERN = r"(?i)(Agent:|Tool Response:|System:|User:|Assistant:)"

# Identifiers.
PDF_ID_PATTERN = r"arxiv\.org/pdf/([0-9]{4}\.[0-9]{4,5}(v\d+)?)\.pdf"
ANY_LINK_ID_PATTERN = r"arxiv\.org/(abs|pdf|html)/([0-9]{4}\.[0-9]{4,5}(v\d+)?)"
NAME_ID_PATTERN = r"^(\d{4}\.\d+v\d+)"
LEDGER_ID_PATTERN = r"(?i)/pdf/(\d{4}\.\d+v\d+)\.pdf\z"
FREE_ID_PATTERN = r"(?i)(\d{4}\.\d{5}(?:v\d+)?)"
PARTIAL_NAME_PATTERN = r"^(\d{4}\.\d+v\d+)\.partial\.json$"

# Response lines of the sentence labeller.
LABEL_LINE_PATTERN = r"句子\s*(\d+)\s*[,，．.、]?\s*标记为\s*([01])"
LABEL_LINE_PATTERN_OLD = r"句子\d+[,，]标记为([01])[。.]"

# Warning limits per stage in milliseconds.
STAGE_LIMITS_MS = [
    ("pdf_download_ms", 120000),
    ("grobid_ms", 60000),
    ("txt_to_json_ms", 15000),
    ("bert_infer_ms", 20000),
    ("latex_src_download_ms", 20000),
    ("latex_extract_ms", 8000),
    ("latex_parse_links_ms", 12000),
    ("latex_build_windows_ms", 6000),
    ("latex_score_filter_ms", 4000),
    ("latex_pick_primary_ms", 3000),
]

# The four fields of a ledger record.
LEDGER_FIELDS = ["Paper Link", "Dataset Link", "Dataset Description", "Timestamp"]

# Members of a source archive that are read, and the largest archive that is opened.
TEXT_MEMBERS = (".tex", ".bib", ".txt", ".md")
SOURCE_MEMBERS = (".tex", ".bib", ".md", ".txt", ".sty", ".cls")
ARCHIVE_LIMIT_BYTES = 50 * 1024 * 1024
