"""Settings in a TOML file: checked when read, written whole or not at all."""

from __future__ import annotations

import os
import tempfile
import tomllib
from dataclasses import asdict, dataclass, fields

from .tree import DEFAULT_EXCLUDES, TreeOptions

#: Where settings, caches, data and state belong below the home folder.
HOMES = {"XDG_CONFIG_HOME": ".config", "XDG_CACHE_HOME": ".cache", "XDG_DATA_HOME": ".local/share", "XDG_STATE_HOME": ".local/state"}
MODES = ("trash", "permanent", "hardlink")


@dataclass(frozen=True)
class Settings:
    min_size: int = 1
    include_hidden: bool = True
    follow_symlinks: bool = False
    cross_filesystems: bool = False
    exclude: tuple[str, ...] = DEFAULT_EXCLUDES
    protected_folders: tuple[str, ...] = ()
    paranoid: bool = False
    workers: int = 0
    use_cache: bool = True
    similar_images: bool = False
    similarity_threshold: int = 8
    default_delete_mode: str = "trash"

    def tree_options(self) -> TreeOptions:
        return TreeOptions(self.min_size, self.include_hidden, self.follow_symlinks, self.cross_filesystems, self.exclude)


#: The largest values of bounded numbers.
LIMITS = {"workers": 64, "similarity_threshold": 16}


def home_of(kind: str, name: str = "twinsift") -> str:
    """The folder of this kind (a key of ``HOMES``); a relative path in the environment counts for nothing."""
    given = os.environ.get(kind, "")
    return os.path.join(given if os.path.isabs(given) else os.path.join(os.path.expanduser("~"), HOMES[kind]), name)


def checked(key: str, value: object, default: object) -> object:
    """The value as the default's type, or a ValueError that names the key."""
    if isinstance(default, tuple):
        if not isinstance(value, list | tuple) or not all(isinstance(x, str) for x in value):
            raise ValueError(f"{key}: a list of texts is needed")
        return tuple(value)
    if type(value) is not type(default):  # true and false are no numbers
        raise ValueError(f"{key}: {type(default).__name__} is needed")
    if isinstance(value, int) and not isinstance(value, bool) and not 0 <= value <= LIMITS.get(key, value):
        raise ValueError(f"{key}: {value} is out of range")
    if key == "default_delete_mode" and value not in MODES:
        raise ValueError(f"{key}: one of {', '.join(MODES)} is needed")
    return value


def load(path: str) -> tuple[Settings, list[str]]:
    """Settings and warnings on unknown keys; a missing file means defaults."""
    if not os.path.exists(path):
        return Settings(), []
    with open(path, "rb") as file:
        given = tomllib.load(file)
    defaults = asdict(Settings())
    known = {k: checked(k, v, getattr(Settings(), k)) for k, v in given.items() if k in defaults}
    return Settings(**known), [f"unknown setting: {k}" for k in given if k not in defaults]


def _written(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, tuple):
        return "[" + ", ".join(map(_written, value)) + "]"
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(value, str) else str(value)


def save(settings: Settings, path: str) -> None:
    """Into a file beside it first, which then takes its place."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as file:
        file.writelines(f"{f.name} = {_written(getattr(settings, f.name))}\n" for f in fields(settings))
    os.replace(file.name, path)
