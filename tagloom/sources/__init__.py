from tagloom.sources.keyed import forget_keyed, load_keyed, save_keyed
from tagloom.sources.selection import first_rows
from tagloom.sources.staging import (
    cut_lineage,
    new_location,
    scratch_space,
    shared_dir,
    stage,
)
from tagloom.sources.store import (
    load_tag_dim,
    load_vectors,
    save_tag_dim,
    save_vectors,
    tag_dim,
)
from tagloom.sources.tables import (
    POSTS_SCHEMA,
    TAGS_SCHEMA,
    WIKI_SCHEMA,
    Corpus,
    CorpusConfig,
    cap_rows,
    conform,
    load_corpus,
    make_corpus,
    read_table,
)

__all__ = [
    "POSTS_SCHEMA",
    "TAGS_SCHEMA",
    "WIKI_SCHEMA",
    "Corpus",
    "CorpusConfig",
    "cap_rows",
    "conform",
    "cut_lineage",
    "first_rows",
    "forget_keyed",
    "load_corpus",
    "load_keyed",
    "load_tag_dim",
    "load_vectors",
    "make_corpus",
    "new_location",
    "read_table",
    "save_keyed",
    "save_tag_dim",
    "save_vectors",
    "scratch_space",
    "shared_dir",
    "stage",
    "tag_dim",
]
