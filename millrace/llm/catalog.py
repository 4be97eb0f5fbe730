"""The queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .covertree import OP5_SQL, op5_covertree
from .drake import OP13_SQL, op13_drake
from .images import op3_images
from .langid import op6_langid
from .licenses import op8_licenses
from .merkle import OP1_SQL, op1_merkle
from .mixing import OP4_SQL, op4_mixing
from .negatives import OP11_SQL, op11_negatives
from .pieces import op9_sentencepiece
from .postings import OP12_SQL, op12_postings
from .simhash import op10_simhash
from .tokenstore import op2_tokenstore
from .toxicity import op7_toxicity

QUERIES = {
    "op1_merkle": op1_merkle,
    "op2_tokenstore": op2_tokenstore,
    "op3_images": op3_images,
    "op4_mixing": op4_mixing,
    "op5_covertree": op5_covertree,
    "op6_langid": op6_langid,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_negatives": op11_negatives,
    "op12_postings": op12_postings,
    "op13_drake": op13_drake,
}

SQL = {
    "op1_merkle": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op5_covertree": OP5_SQL,
    "op11_negatives": OP11_SQL,
    "op12_postings": OP12_SQL,
    "op13_drake": OP13_SQL,
}
