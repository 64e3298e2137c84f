from assaylake.sources.cache import cached  # noqa: F401
from assaylake.sources.io import (  # noqa: F401
    flatten_records, prompt_path, read_assay, scratch_path, union_assays,
    write_assay, write_chat_jsonl, write_folds,
)
