"""Character classes, thresholds and tables that operators share, as text that Spark's and DuckDB's regular expressions both read."""

from __future__ import annotations

# Characters that count as Han in runs.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
LATIN = "a-z"
SCRIPTS = {"han": HAN, "latin": LATIN}

# White space between sentences, and white space that is trimmed from dictionary texts.
BLANK = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TRIMMED = r"\t\n\x0B\f\r\x{85} \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Characters that end a sentence.
ENDS = "。！？!?"
SENTENCE = f"[^{BLANK}{ENDS}]*[{ENDS}]|[^{BLANK}{ENDS}]+"

# Elements that bound a block of text.
BLOCK_TAGS = ("p", "div", "li", "article", "section", "td", "th", "body")
BLOCK = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>"

# Longest word of the segmenter; twice the score of a single character in and not in the dictionary, and of each character of a longer word.
MAX_WORD = 6
KNOWN_SINGLE, UNKNOWN_SINGLE, PER_CHARACTER = -1, -4, 3

# Seconds between saved locations, and from the end of a press to a tap that it swallows.
SAVE_SECONDS = 0.5
TAP_SECONDS = 0.1

# Accented vowels by tone, 1 to 5.
TONES = {"a": "āáǎàa", "e": "ēéěèe", "i": "īíǐìi", "o": "ōóǒòo", "u": "ūúǔùu", "ü": "ǖǘǚǜü"}

# Classifier mark, and what pinyin in brackets may hold.
CLASSIFIER = "CL:"
PINYIN = r"\[([A-Za-z0-9 ]+)\]"
HEAD_SPARK, HEAD_DUCK = r"\p{IsHan}", r"\p{Han}"

# Characters that the query part of a URL keeps besides letters and digits.
QUERY_KEPT = "-._~!$&'()*+,/:;=?@"
