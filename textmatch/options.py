"""Settings of the text-reuse jobs.

The word lists below are fixed values: results depend on them literally.
In the border and separator lists ``\\n`` stands for a line break and ``\\\\n``
for the two characters backslash + n, which PDF extractors leave behind.
"""

from __future__ import annotations

from dataclasses import dataclass

# Indonesian conjunctions, never counted as matching words.
STOP_WORDS: tuple[str, ...] = tuple(
    "andaikan,andai,sekiranya,kira,seandainya,jika,kalau,asalkan,bila,sesudah,sudah,"
    "sebelum,belum,sejak,ketika,sementara,agar,supaya,dengan,bahwa,seolah-olah,seolah,"
    "seakan-akan,akan,seperti,sebab,karena,meskipun,walaupun,walau,biarpun,biar,"
    "sekalipun,dan,tetapi,atau,setelah,sambil,sebagaimana,bagaimana,disamping,"
    "berdasarkan,jadi,serta,lagipula,tapi,sebaliknya,sedangkan,sebelumnya,setelahnya,"
    "sampai,demi,semenjak,tatkala,untuk,apabila,jikalau,yakni,apalagi,misalnya,yaitu,"
    "akhirnya,kendatipun,kemudian,lalu,kecuali,selain,padahal".split(",")
)

# Headings that close the front matter, tried in this order.
_OPENING_BORDERS = (
    r"BAB I \nPENDAHULUAN,BAB I \\nPENDAHULUAN,BAB I \n\nPENDAHULUAN,"
    r"BAB I \\n\\nPENDAHULUAN,BAB I \n\n \n\nPENDAHULUAN,BAB I \\n\\n \\n\\nPENDAHULUAN,"
    r"Bab I. Pendahuluan,BAB I\n\nPENDAHULUAN,BAB I\\n\\nPENDAHULUAN,"
    r"BAB I   \n\nPENDAHULUAN,BAB I   \\n\\nPENDAHULUAN,BAB I    Pendahuluan,"
    r"BAB I. \n\nPENDAHULUAN,BAB I. \\n\\nPENDAHULUAN,I. PENDAHULUAN,1 PENDAHULUAN,"
    r"BAB – I \nPENDAHULUAN,BAB – I \\nPENDAHULUAN,1 BAB I  \n\nPENDAHULUAN,"
    r"1 BAB I  \\n\\nPENDAHULUAN,BAB  I \nPENDAHULUAN,BAB  I \\nPENDAHULUAN,"
    r"BAB I \n \n\nPENDAHULUAN,BAB I \\n \\n\\nPENDAHULUAN,BAB  I \n\nPENDAHULUAN,"
    r"BAB  I \\n\\nPENDAHULUAN,BAB I PENDAHULUAN,"
    r"BAB I - 1 \n\n \n\nBAB I  \n\n \n\nPENDAHULUAN,"
    r"BAB I - 1 \\n\\n \\n\\nBAB I  \\n\\n \\n\\nPENDAHULUAN,BAB I  \n\nPENDAHULUAN,"
    r"BAB I  \\n\\nPENDAHULUAN,\nPENDAHULUAN,\\nPENDAHULUAN,\nPendahuluan,\\nPendahuluan,"
    r"\nBab I,\\nBab I,\nBAB I,\\nBAB I,\nI. Latar Belakang,\\nI. Latar Belakang,"
    r"\nI Latar Belakang,\\nI Latar Belakang"
)

# Paragraph separators, tried in this order.
_PARAGRAPH_SEPARATORS = r"\\n\\n,\n\n\n\n,\\n\\n\\n\\n,\n\n \n\n,\\n\\n \\n\\n,\n\n,\\n\\n,\n,\\n"


def _as_text(settings: str) -> tuple[str, ...]:
    """Turn the notation above into the characters found in real text."""
    parts = settings.split(",")
    return tuple(
        p.replace(r"\\n", "\0").replace(r"\n", "\n").replace("\0", r"\n") for p in parts
    )


OPENING_BORDERS = _as_text(_OPENING_BORDERS)
PARAGRAPH_SEPARATORS = _as_text(_PARAGRAPH_SEPARATORS)

SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


@dataclass(frozen=True)
class Options:
    """Defaults of every job; build another instance to change them."""

    min_space: int = 26
    max_dots: int = 200
    min_paragraphs: int = 20
    max_chapter_pieces: int = 6
    chapters: tuple[str, str] = ("III", "V")
    layers: tuple[int, ...] = (-1,)
    batch_size: int = 32
    max_seq_length: int = 128
    words_per_file: int = 1000
    threshold: float = 0.9
    verdict_percent: float = 10.0
    clusters: int = 10
    neighbours: int = 1000
    seed: int = 42
    max_predictions: int = 20
    short_seq_prob: float = 0.1
    masked_prob: float = 0.15
    dupe_factor: int = 5
    vocab_size: int = 32000
    min_frequency: int = 2
    max_alphabet: int = 1000
    max_word_chars: int = 200


DEFAULTS = Options()
