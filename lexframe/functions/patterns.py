"""Fixed values that must equal the surveyed behaviour for right results.

Everything here is data, stated plainly and in natural order: the row
classification patterns (Java regex; ``(?sU)`` makes ``\\s \\w \\d`` Unicode
aware and ``.`` span newlines, as Python ``re`` does on ``str``), the node
types and their depth ranks, the enactment markers, the URL and path
patterns and the tool names.
"""

# ---- fixed values: node types ------------------------------------------------
SECTION_TYPES = ("act", "part", "section", "subsection", "paragraph",
                 "subparagraph", "schedule", "chapter", "article")

# ---- fixed values: depth rank of each node type -----------------------------
# chapter shares the rank of part, so a chapter is a sibling of its part.
RANKS = {"act": 0, "part": 1, "schedule": 1, "chapter": 1, "section": 2,
         "article": 2, "subsection": 3, "paragraph": 4, "subparagraph": 5}
MAX_RANK = 5

# ---- fixed values: row classification, first match wins ---------------------
# (type, pattern, how the ref is formed from group 1, where group 2 goes)
CLASSIFY_RULES = (
    ("part", r"(?sU)^PART\s+(\w+)(.*)", "{}", "title"),
    ("schedule", r"(?sU)^SCHEDULE\s+(\w+)(.*)", "Schedule {}", "title"),
    ("chapter", r"(?sU)^CHAPTER\s+(\w+)(.*)", "Chapter {}", "title"),
    ("article", r"(?sU)^Article\s+(\d+)(.*)", "Article {}", "title"),
    ("section", r"(?sU)^(\d+)\s*[.—–]\s*(.*)", "{}", "text"),
    ("subsection", r"(?sU)^\((\d+)\)\s*(.*)", "{}", "text"),
    ("paragraph", r"(?sU)^\(([a-z]{1,3})\)\s*(.*)", "{}", "text"),
)
# a paragraph ref made only of these letters is a subparagraph
ROMAN_REF = r"^[ivxlcdm]+$"

# ---- fixed values: enactment and title markers ------------------------------
ENACTING_MARKERS = ("BE IT ENACTED", "HEREBY ENACTED")
TITLE_STOP_WORD = "ENACTED"
TITLE_KEYWORD = "ACT"

# ---- fixed values: keys from URLs and paths ---------------------------------
ELI_URL = r"/eli/(\d+)/act/(\d+)/"
ACT_PATH = r"[/\\](\d{4})[/\\]act_(\d+)\.html$"
INDEX_LINK = r"/(\d+)/index\.html$"
PRINT_PATH = "/eli/{year}/act/{number}/enacted/en/print.html"
YEAR_INDEX_PATH = "/eli/{year}/act/"

# ---- fixed values: lookup tools ---------------------------------------------
TOOLS = ("search_laws", "get_law_by_name", "get_law_sections", "get_section_by_ref")

# ---- fixed values: evaluation ratings ---------------------------------------
RATINGS = ("unrated", "good", "bad")
DEFAULT_TOP_K = 5
SWEEP_K = tuple(range(2, 10))

# ---- fixed values: embeddable node types ------------------------------------
EMBED_TYPES = ("section", "subsection")

# ---- fixed values: HTML entities decoded by the regex shredder --------------
# ``&amp;`` is decoded last so ``&amp;lt;`` stays ``&lt;``.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&nbsp;", " "), ("&amp;", "&"))
