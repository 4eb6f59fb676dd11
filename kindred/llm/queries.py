"""The queries of this subpackage. None of their results can be written as SQL; tests hold them against brute force."""

from kindred.llm.language import op4_language
from kindred.llm.lines import op3_lines
from kindred.llm.mixing import op8_mixing
from kindred.llm.neighbours import op10_neighbours
from kindred.llm.packing import op7_packing
from kindred.llm.personal import op9_personal
from kindred.llm.quality import op6_quality
from kindred.llm.simhash import op5_simhash
from kindred.llm.suffix_tree import op1_suffix_tree
from kindred.llm.token_files import op2_token_files

QUERIES = {f.__name__: f for f in (op1_suffix_tree, op2_token_files, op3_lines, op4_language, op5_simhash, op6_quality, op7_packing, op8_mixing, op9_personal, op10_neighbours)}
ORACLE_SQL: dict[str, str] = {}
