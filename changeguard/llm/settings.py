"""Parameters of the registered queries and the pipeline."""

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A deployment passes its own secret; surrogates can only be repeated with it.
PII_KEY = "public test key"
