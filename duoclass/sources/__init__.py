"""Text sources (dense CSV, keyed sparse, svmlight, one-hot tokens), line builders
that derive such text from the given tables, and the Parquet parameter store."""

from duoclass.sources.text import (  # noqa: F401
    read_lines, with_row_id, parse_dense_csv, parse_keyed_sparse, parse_svmlight,
    parse_onehot_tokens, svmlight_base, quarantine_report, good_rows,
)
from duoclass.sources.standins import (  # noqa: F401
    dense_csv_lines_from_lineitem, keyed_lines_from_embeddings,
    svm_lines_from_embeddings, token_lines_from_embeddings, folded_keyed_lines,
)
