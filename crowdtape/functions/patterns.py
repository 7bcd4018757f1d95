"""Character classes shared by the text functions.

Java's ``\\w`` and ``\\s`` are ASCII only and its Unicode mode also counts combining marks as word
characters, so the classes are spelled out: letters, numbers and underscore form words, and every
Unicode blank is a blank.
"""

WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"

# What counts as a hashtag, a user name and a link.
HASHTAG = rf"#[{WORD}]+"
SPACED_HASHTAG = rf"#[{BLANK}]+[{WORD}]+|#[{WORD}]+"
USERNAME = rf"@[{WORD}]+"
LOOSE_LINK = rf"(?i)http[^{BLANK}]+|www[^{BLANK}]+"

# Fixed value: the grammar of a well-formed web address.
STRICT_LINK = r"(?i)(https?:\/\/(?:www\.|(?!www))[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}|www\.[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}|https?:\/\/(?:www\.|(?!www))[a-zA-Z0-9]+\.[^\s]{2,}|www\.[a-zA-Z0-9]+\.[^\s]{2,})"

# What the first cleaning step deletes: links, user names, hashtags and digit runs.
ENTITY = rf"http[^{BLANK}]+|www[^{BLANK}]+|@[{WORD}]+|#[{WORD}]+|\p{{Nd}}+"
BLANK_RUN = rf"[{BLANK}]{{2,}}"
SYMBOL = rf"[^{WORD}{BLANK}]"
