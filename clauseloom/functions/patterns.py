"""The patterns and word lists that agreement text is read with.

Java flavour; ``uni`` adds the flags under which white space, word characters and line ends are Unicode's.
"""

MD_HEADING = r"^#{1,6}\s+(.+?)\s*#*\s*$"
LIST_START = r"^\s*(?:\d+(?:\.\d+)*[.)]\s|\(?(?:[a-z]|[ivx]{2,4})[.)]\s|[-*\x{2022}]\s|#{1,6}\s)"
BOLD_ONLY = r"^\s*(?:\*\*|__)[^*_\n]{2,100}(?:\*\*|__)\s*:?\s*$"
ALL_CAPS = r"^[A-Z][A-Z0-9 ,&'\-/()]{5,80}$"
BOLD_TITLE = r"^\s*(?:\d+[.)]\s+)?(?:\*\*|__)(.+?)(?:\*\*|__)"
TAG = r"</?[A-Za-z][^>]*>"
RULE = r"^\s*(?:-{3,}|={3,})\s*$"
GLUE = r"(?:[a-z]{3,}|[.!?)])[A-Z][a-z]{2,}"
BULLET = r"^\s*[-*\x{2022}]\s+(.+?)\s*$"
BULLET_LINE = r"^[-*\x{2022}]\s+"
NUMBERED = r"^(\d+(?:\.\d+)*)[.)]\s+(\S.*)$"
LETTERED = r"^\(?([a-z]|[ivx]{2,4})[.)]\s+(\S.*)$"
BOLD_START = r"^(?:\*\*|__)([^*_\n]{2,80}?)(?:\*\*|__)\s*:?\s*(.*)$"
BOLD_LABEL = r"^(?:\*\*|__)(\d+(?:\.\d+)*|[a-z]{1,4})[.)](?:\*\*|__)\s*(\S.*)$"
LABEL_PREFIX = r"^\(?(?:\d+(?:\.\d+)*|[a-z]|[ivx]{2,4})[.)]\s+"
FIRST_SENTENCE = r"^([^.:!?]{2,80}?)[.:]\s+(\S.*)$"
ITALIC = r"(?<![\w*])\*(?!\s)([^*\n]+?)(?<!\s)\*(?![\w*])"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[\"\x{201c}'(\[]?[A-Z0-9])"
CLAUSE_GAP = r"(?<=;)\s+"
FOOTER_LABEL = r"^[A-Z][\w &]{2,30}: [-*\x{2022}] "
YEAR = r"\b(?:19|20)\d{2}\b"
NOT_TITLE = r"[:|]|https?://|www\.|@"
SLUG_DROP = r"[^\w\s-]"

# Of the data-quality rules.
ITEM_LABEL = r"^(?:[a-z]\. |[ivxlcdm]+\. |\([a-z]\) |\([ivxlcdm]+\) |\d+\. )"
BARE_LABEL_HEADING = r"^[a-z]\.\s*(\(part \d+/\d+\))?$"
STALE_LABEL_HEADING = r"^[a-z]\. > "
MOJIBAKE = ["â€™", "Ã©", r"Ã\xa9", r"\ufffd", "�"]
ODD_CHARS = r"[\n:+<&\\âÃ]"
HTML_TAG, HTML_ENTITIES = r"<[a-zA-Z][^>]*>", ["&amp;", "&lt;", "&gt;", "&nbsp;"]
HTML_DEBRIS = "|".join([HTML_TAG, *HTML_ENTITIES])
HEADING_DEBRIS = r"\*\*|\*[^*]|^\*$|-{4,}|={4,}"
PART_LABEL = r"\(part (\d+)/(\d+)\)"
JUNK_NAV = r"\b[A-Z][a-z]+(?: \+ [A-Z][a-z]+){2,}"

# Of the repair rules.
NAV_LINE = r"^[A-Z][a-z]+(?: \+ [A-Z][a-z]+){2,}$"
GLUED_WORD = r"[a-z]{2}[A-Z][a-z]{2}"
ITEM_LINE = r"^([a-z])\. ([A-Z][^.]*?)\.?\s"
SHORT_ITEM = r"^([a-z])\. ([A-Z][a-zA-Z ]+?)[. ]"
GENERIC_HEADING = r"^Item \d+$"
NUMBERED_HEADING = r"^\d+\."
BARE_PART, STALE_PART = r"^([a-z])\. \(part (\d+)/(\d+)\)$", r"^([a-z])\. > (.+)$"
FIRST_NAME = r"^([A-Z][^.]+?)\."
FOOTER_WORDS = ["Support", "Cookie Settings", "Careers", "Help", "---"]
# In this order: an earlier entry can take the beginning of a later one away.
MOJIBAKE_FIXES = [
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("Ã©", "é"),
    ("�", ""),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("<br>", "\n"),
    ("<br/>", "\n"),
    ("<br />", "\n"),
]

STOPWORDS = ["a", "an", "and", "or", "of", "to", "the", "for", "in", "on", "by", "with", "at", "from", "as", "vs", "per", "is", "&"]
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "inc.", "ltd.", "pvt.", "co.", "mr.", "mrs.", "dr.", "u.s.", "vs.", "cf."]
# White space of ASCII alone, as in RE2's flavour; (?i) of ASCII but for the long s.
_BLANK = r"[\t\n\f\r ]"
ASCII_HEADING = rf"(?d)^#{{1,6}}{_BLANK}+(.+?){_BLANK}*#*{_BLANK}*\z"
ABBREVIATION_GAP = "(?i)((?:" + "|".join(a[:-1].replace(".", r"\.").replace("s", "[s\u017f]") for a in ABBREVIATIONS) + rf")\.){_BLANK}+"
ASCII_SENTENCE_GAP = rf"([.!?]){_BLANK}+([\"\x{{201c}}'(\[]?[A-Z0-9])"
OPENING_QUOTES = "(\"'“‘"
TERMS_KEYWORDS = ["terms of service", "terms of use", "conditions of use", "eula", "license", "licence", "agreement"]
PRIVACY_KEYWORDS = ["privacy"]

MIN_LEN, MAX_LEN = 150, 1500
HEADING_MAX, TITLE_CHARS, TITLE_WORDS, COLON_WORDS, SNIPPET_WORDS, LEAD_IN_MAX, PARENT_MAX = 100, 80, 12, 6, 8, 200, 40
FUZZY_CUTOFF, FOOTER_LINES = 0.8, 6


def uni(pattern: str) -> str:
    return "(?Ud)" + pattern
