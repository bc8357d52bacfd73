"""A session: named datasets, file handles, settings, titles, and the commands that act on them rather than on cases."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.frame import Frame, Meta
from quillstat.sources import files, sav

#: Settings and what they are before anything is set.
SETTINGS = {"MXLOOPS": 40, "SEED": 2_000_000, "FORMAT": "F8.2", "EPOCH": 1930, "UNDEFINED": "WARN", "DECIMAL": "DOT", "HEADER": False, "WORKSPACE": 65_536}


class Session:
    """``active`` is the frame that commands work on; None before data are read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.datasets: dict[str, Frame | None] = {}
        self.active: Frame | None = None
        self.name: str | None = None
        self.handles: dict[str, tuple[str, dict]] = {}
        self.settings = dict(SETTINGS)
        self.saved_settings: list[dict] = []
        self.titles = ["", ""]
        self.folder = ""
        self.output: list[str] = []

    # -- datasets -----------------------------------------------------------

    def use(self, frame: Frame) -> Frame:
        """Replace the active dataset."""
        self.active = frame
        if self.name is not None:
            self.datasets[self.name] = frame
        return frame

    def new_file(self) -> None:
        self.active = None
        if self.name is not None:
            self.datasets[self.name] = None

    def dataset_name(self, name: str) -> None:
        """Name the active dataset; a dataset that had the name loses it."""
        if self.name is not None:
            self.datasets.pop(self.name, None)
        self.datasets[name], self.name = self.active, name

    def dataset_declare(self, name: str) -> None:
        self.datasets.setdefault(name, None)

    def dataset_copy(self, name: str) -> None:
        self.datasets[name] = self.active

    def dataset_activate(self, name: str) -> Frame | None:
        """Make a named dataset active; an unnamed active one is dropped."""
        self.active, self.name = self.datasets[name], name
        return self.active

    def dataset_close(self, name: str = "*") -> None:
        """Close a dataset, the active one (``*``: it keeps its cases but loses its name) or ALL."""
        if name == "ALL":
            self.datasets.clear()
            self.name = None
            self.new_file()
        elif name == "*" or name == self.name:
            self.datasets.pop(self.name, None)
            self.name = None
        else:
            del self.datasets[name]

    def dataset_display(self) -> DataFrame:
        return self.spark.createDataFrame([(n, n == self.name) for n in sorted(self.datasets)], "dataset string, active boolean")

    # -- files ----------------------------------------------------------------

    def cd(self, folder: str) -> None:
        self.folder = folder

    def file_handle(self, name: str, path: str, **options) -> None:
        self.handles[name] = (path, options)

    def close_file_handle(self, name: str) -> None:
        del self.handles[name]

    def path(self, file: str) -> str:
        """A handle's path, or the path itself, below the session's folder unless it is absolute."""
        file = self.handles.get(file, (file, {}))[0]
        return file if not self.folder or file.startswith("/") or ":/" in file else f"{self.folder.rstrip('/')}/{file}"

    def _picked(self, frame: Frame, keep: Iterable[str] | None, drop: Iterable[str], rename: dict[str, str] | None) -> Frame:
        frame = frame.rename_variables(**(rename or {}))
        return frame.modify_vars(keep=keep, drop=drop)

    def get(self, file: str, keep: Iterable[str] | None = None, drop: Iterable[str] = (), rename: dict[str, str] | None = None) -> Frame:
        """Read a system file, or a Parquet folder, told apart by the first bytes; renames come first, then KEEP and DROP."""
        path = self.path(file)
        head = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 3 and not path like '%/_SUCCESS'").orderBy("path").select(F.substring("content", 1, 4).alias("head")).first()
        if head is None:
            raise FileNotFoundError(path)
        magic = bytes(head["head"])
        frame = sav.read_sav(self.spark, path) if sav.is_sav(magic) else Frame(self.spark.read.parquet(path))
        if not sav.is_sav(magic) and magic != b"PAR1":
            raise ValueError(f"{path} is neither a system file nor Parquet")
        return self.use(self._picked(frame, keep, drop, rename))

    def save(self, file: str, keep: Iterable[str] | None = None, drop: Iterable[str] = (), rename: dict[str, str] | None = None, frame: Frame | None = None) -> None:
        """Write a system file, a part for each partition."""
        sav.write_sav(self._picked(frame or self.active, keep, drop, rename), self.path(file))

    def xsave(self, file: str, **picks) -> Callable[[], None]:
        """A save of the dataset as it is now, to be run together with the next procedure."""
        frame = self.active
        return lambda: self.save(file, frame=frame, **picks)

    def erase(self, file: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(file))
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True):
            raise FileNotFoundError(self.path(file))

    def sysfile_info(self, file: str) -> DataFrame:
        """The variables of a system file."""
        return sav.read_sav(self.spark, self.path(file)).display_dictionary()

    def begin_data(self, lines: list[str], names: list[tuple[str, str]], kind: str = "list") -> Frame:
        """Inline data between BEGIN DATA and END DATA, read as DATA LIST reads a file; they are as large as a program's text."""
        from quillstat import ordering

        path = f"{ordering.shared_dir(self.spark)}/inline-{len(self.output)}-{abs(hash(tuple(lines)))}"
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
        read = {"list": files.data_list_list, "free": files.data_list_free, "fixed": files.data_list_fixed}[kind]
        return self.use(Frame(read(self.spark, path, names)))

    def input_program(self, schema: str, make: Callable[[int], Iterable[tuple]], parts: int = 1) -> Frame:
        """INPUT PROGRAM: ``make(part)`` yields the cases (END CASE) of each part and ends (END FILE) by returning; parts run as tasks."""
        import pandas as pd

        kinds = self.spark.createDataFrame([], schema).schema

        def run(frames):
            for f in frames:
                for part in f["id"]:
                    held = []
                    for case in make(int(part)):
                        held.append(case)
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=kinds.names)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=kinds.names)

        return self.use(Frame(self.spark.range(0, parts, 1, parts).mapInPandas(run, kinds)))

    def reread(self, column: str, fields: list[tuple[str, int, int, str]]) -> Frame:
        """Read fields again from the line that each case holds in ``column``."""
        cut = {n: files._typed(F.trim(F.substring(column, a, b - a + 1)) if k == "N" else F.substring(column, a, b - a + 1), k) for n, a, b, k in fields}
        return self.use(replace(self.active, df=self.active.df.withColumns(cut)))

    # -- settings, titles and output ---------------------------------------------

    def set(self, **settings) -> None:
        for k, v in settings.items():
            self.settings[k.upper()] = v

    def show(self, *names: str) -> DataFrame:
        names = [n.upper() for n in names] or sorted(self.settings)
        return self.spark.createDataFrame([(n, str(self.settings[n])) for n in names], "setting string, value string")

    def preserve(self) -> None:
        self.saved_settings.append(dict(self.settings))

    def restore(self) -> None:
        self.settings = self.saved_settings.pop()

    def title(self, text: str) -> None:
        self.titles = [text, ""]

    def subtitle(self, text: str) -> None:
        self.titles[1] = text

    def file_label(self, text: str) -> Frame:
        return self.use(replace(self.active, meta=replace(self.active.meta, title=text)))

    def datafile_attribute(self, **entries: str) -> Frame:
        return self.use(self.active.variable_attribute("", **entries))

    def echo(self, text: str) -> None:
        self.output.append(text)

    def print_eject(self) -> None:
        self.output.append("\f")

    def print_space(self, lines: int = 1) -> None:
        self.output += [""] * lines

    def variable_display(self, what: str, **by_name) -> Frame:
        """VARIABLE ALIGNMENT and VARIABLE WIDTH: how a variable is shown."""
        frame = self.active
        for name, value in by_name.items():
            frame = frame.variable_attribute(name, **{f"$display.{what}": str(value)})
        return self.use(frame)

    # -- running -----------------------------------------------------------------

    def cache(self) -> Frame:
        """Write the active dataset to the shared folder once, so that later procedures don't compute it again."""
        from quillstat import ordering

        return self.use(replace(self.active, df=ordering.store(self.active.df, "cache")))

    def execute(self) -> int:
        """Run the pending transformations; returns the number of cases."""
        return self.active.df.count()

    def use_all(self) -> Frame:
        """USE ALL: no filter and no limit."""
        return self.use(replace(self.active, filter_by=None, limit=None))

    def finish(self) -> None:
        """FINISH, EXIT, QUIT: forget all datasets, handles and titles."""
        self.__init__(self.spark)


def empty(spark: SparkSession, schema: str, meta: Meta | None = None) -> Frame:
    """A frame of declared variables without cases."""
    return Frame(spark.createDataFrame([], schema), meta or Meta())
