"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from .ann import op2_nearest_neighbours
from .bpe import op5_bpe
from .chat import op1_chat_formatting
from .html import op6_html_extraction
from .mixing import OP3_SQL, op3_mixing
from .near import op10_near_duplicates
from .quality import op7_quality_rules
from .quality_model import op9_quality_classifier
from .tokens import op4_token_counts
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_nearest_neighbours, op3_mixing, op4_token_counts, op5_bpe, op6_html_extraction, op7_quality_rules, op8_toxicity, op9_quality_classifier, op10_near_duplicates)}
SQL = {"op3_mixing": OP3_SQL}
