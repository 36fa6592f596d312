"""The queries of the subpackage, and SQL for those that it can express."""

from .ann import op4_neighbours
from .bpe import op8_bpe
from .jaccard import op9_jaccard
from .langid import op10_language
from .media import op7_media
from .mixing import OP2_SQL, op2_mixing
from .pages import op5_pages
from .quality import op1_quality
from .suffix import op6_suffix
from .tokenstore import op3_tokenstore

QUERIES = {"op1_quality": op1_quality, "op2_mixing": op2_mixing, "op3_tokenstore": op3_tokenstore, "op4_neighbours": op4_neighbours, "op5_pages": op5_pages, "op6_suffix": op6_suffix, "op7_media": op7_media, "op8_bpe": op8_bpe, "op9_jaccard": op9_jaccard, "op10_language": op10_language}
ORACLE = {"op2_mixing": OP2_SQL}
