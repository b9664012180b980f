"""Hidden and temporary items: the topmost matching component of each path, its size and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Names that are essential configuration, and metadata of systems.
PROTECTED_NAMES = (
    ".bashrc .bash_profile .bash_logout .bash_history .profile .zshrc .zprofile .zshenv .zlogin .zsh_history "
    ".ssh .config .gnupg .local .git .gitconfig .gitignore .gitattributes .gitmodules .vimrc .vim .npmrc .env "
    ".mozilla .thunderbird .docker .kube .aws .netrc .xinitrc .Xauthority .xprofile .inputrc .tmux.conf .pki "
    ".password-store .cargo .rustup .conda .pam_environment"
).split()
OS_METADATA = ("desktop.ini", ".DS_Store", "Thumbs.db")
PRESELECTED = (".DS_Store", "Thumbs.db")
OFFICE_LOCK, TILDE, BACKUP = "Office lock file", "Tilde file", "Editor backup"
METADATA, SWAP, TEMPORARY = "OS metadata", "Editor swap file", "Temporary file"
DOT_FOLDER, DOT_FILE = "Hidden folder", "Hidden file"


def classify(name: Column, is_dir: Column, temp_patterns: bool = True) -> Column:
    """The category of a name, null if it is neither hidden nor temporary."""
    file = ~is_dir if temp_patterns else F.lit(False)
    return (
        F.when(name.startswith("~$"), OFFICE_LOCK)
        .when(name.startswith("~"), TILDE)
        .when(name.endswith("~"), BACKUP)
        .when(file & name.isin(*OS_METADATA), METADATA)
        .when(file & (name.endswith(".swp") | name.endswith(".swo")), SWAP)
        .when(file & name.endswith(".tmp"), TEMPORARY)
        .when(name.startswith(".") & is_dir, DOT_FOLDER)
        .when(name.startswith("."), DOT_FILE)
    )


def is_protected(path: Column) -> Column:
    return F.arrays_overlap(paths.components(path), F.array(*map(F.lit, PROTECTED_NAMES)))


def is_home_dot(path: Column, home: str) -> Column:
    """A dot entry right below the home folder, or anything inside one."""
    return path.rlike(r"^\Q" + home.rstrip("/") + r"\E/\.")


def _steps(rows: DataFrame, root: str, is_dir: Column, temp_patterns: bool) -> DataFrame:
    """Rows with ``parts`` below the root, their ``kinds`` and ``at``, the first that has one (0: none)."""
    base = root.rstrip("/")
    below = paths.components(F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path")))
    steps = rows.where(F.startswith("path", F.lit(base + "/"))).withColumns({"parts": below, "folder": is_dir})
    kinds = F.transform("parts", lambda x, i: classify(x, (i < F.size("parts") - 1) | F.col("folder"), temp_patterns))
    first = F.array_position(F.transform(kinds, lambda x: x.isNotNull()), True)
    return steps.withColumn("kinds", kinds).withColumn("at", first.cast("int"))


def outside(rows: DataFrame, root: str, temp_patterns: bool = True) -> DataFrame:
    """Rows (path...) that lie neither in an item nor are one; what failed inside an item only makes it smaller."""
    found = _steps(rows, root, F.lit(True), temp_patterns)
    kept = found.where("at = 0").select(*rows.columns)
    return kept.unionByName(rows.where(~F.startswith("path", F.lit(root.rstrip("/") + "/"))))


def items(files: DataFrame, root: str, home: str, open_files: DataFrame | None = None, temp_patterns: bool = True) -> DataFrame:
    """(path, is_dir, size, category, protected, home_dot, preselect) from listed entries.

    ``files`` has (path, size); its folders follow from its paths.  With ``is_dir`` it has folders too, so that
    empty ones are items, and links, which count by their own size.  What lies inside an item
    adds to the item's size and is no item itself; folders add nothing.
    """
    base = root.rstrip("/")
    own = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    topmost = _steps(files, root, own, temp_patterns).where("at > 0")
    found = topmost.select(
        F.concat(F.lit(base + "/"), F.array_join(F.slice("parts", F.lit(1), F.col("at")), "/")).alias("path"),
        ((F.col("at") < F.size("parts")) | F.col("folder")).alias("is_dir"),
        F.element_at("kinds", F.col("at")).alias("category"),
        F.when(F.col("folder"), 0).otherwise(F.col("size")).alias("size"),
    )
    summed = found.groupBy("path", "is_dir", "category").agg(F.sum("size").alias("size"))
    path, name = F.col("path"), paths.name(F.col("path"))
    held = F.lit(False)
    if open_files is not None:
        held = F.coalesce(F.col("held"), F.lit(False))
        summed = summed.join(open_files.select("path", F.lit(True).alias("held")).distinct(), "path", "left")
    wanted = (
        F.col("category").isin(OFFICE_LOCK, BACKUP) | name.isin(*PRESELECTED)
        | ((F.col("category") == SWAP) & name.endswith(".swp") & ~held)
    )
    found = summed.select(
        "path", "is_dir", "size", "category", is_protected(path).alias("protected"),
        is_home_dot(path, home).alias("home_dot"), wanted.alias("wanted"),
    )
    return found.withColumn("preselect", ~F.col("protected") & ~F.col("home_dot") & F.col("wanted")).drop("wanted")


def tree_sizes(files: DataFrame, root: str) -> DataFrame:
    """(folder, n_files, size): all that lies below each folder below the root."""
    parts = paths.components(F.col("path"))
    least = len([x for x in root.split("/") if x])
    above = F.transform(
        F.sequence(F.lit(least), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )
    under = files.where(F.startswith("path", F.lit(root.rstrip("/") + "/")))
    return under.select(F.explode(above).alias("folder"), "size").groupBy("folder").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("size")
    )


def notes(item_protected: Column, home_dot: Column) -> Column:
    return F.concat_ws(
        "; ",
        F.when(item_protected, "Protected: essential configuration"),
        F.when(home_dot, "Inside a hidden folder of your home"),
    )


def is_risky(protected: Column, home_dot: Column) -> Column:
    """Whether selecting an item asks for a confirmation of its own."""
    return protected | home_dot


def reclaimable_preselected(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum(F.when(F.col("preselect"), F.col("size"))), F.lit(0)).alias("reclaimable_preselected"), F.count_if("preselect").alias("n"))
