from panelweave.sources.delimited import read_delimited, write_delimited
from panelweave.sources.staging import enable_checkpoints, shared_dir, stage, staged, staging_path

__all__ = [
    "enable_checkpoints",
    "read_delimited",
    "shared_dir",
    "stage",
    "staged",
    "staging_path",
    "write_delimited",
]
