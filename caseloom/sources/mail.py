"""Mail as a Spark source: "mail" reads a folder of mail files, as a table or as a stream whose offset is the message number.

    spark.dataSource.register(MailSource)
    spark.read.format("mail").load(folder)
    spark.readStream.format("mail").option("after", 120).load(folder)

A message's number is the digits at the end of its file's name (``inbox_000121.eml``); a name without digits is number 0. Mailboxes number
messages in rising order and never again, so a number is a high-water mark: everything up to it was taken. Options:

- ``after``: numbers up to this one are left out (a table's mark; see ``mark``). So a stream whose checkpoint is lost goes on where its table ends.
- ``most``: most files that a task reads (1,000); of a shelf, most numbers.
- ``per_batch``: most files that a micro-batch takes; the others wait for the next. All, if not given, as one that runs to the present end should.
- ``glob``: names of files, ``*.eml`` if not given.

The folder is any that pyarrow's file systems open (local, hdfs, s3, …). Mails lie in it, or on its *shelves*: a subfolder named by a number k, in nine
digits or more, has the mails k * 1,000 to k * 1,000 + 999 (others there aren't looked at). Of shelves the driver knows the names only, and tasks list them: what it holds and sends out
is a thousandth of the mails. It lists itself what lies in the folder without a shelf, so a large mailbox, and what ``write_mail`` writes, is on shelves. Mails
are read and parsed in tasks, a file at a time. A file that can't be parsed gives a row with its number, its name and ``error``; one that is gone gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from email import message_from_bytes, policy
from email.errors import MessageError
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText
from fnmatch import fnmatch
from heapq import merge
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import sender_address, sender_name, strip_tags

SCHEMA = (
    "number long, filename string, message_id string, date string, sender_raw string, recipient string, subject string, plain string, html string, "
    "attachments array<struct<filename:string,content_type:string,size_bytes:long,bytes:binary>>, error string"
)


def number_of(name: str) -> int:
    digits = re.search(r"(\d+)\.[^.]*$", name)
    return int(digits[1]) if digits else 0


def parsed(name: str, raw: bytes) -> tuple:
    """A mail's row: bodies of text parts joined, parts with a file name as attachments."""
    empty = (number_of(name), name, None, None, None, None, None, "", "", [])
    try:
        mail = message_from_bytes(raw, policy=policy.compat32)
        plain, html, files = [], [], []
        for part in mail.walk():
            if part.is_multipart():
                continue
            body = part.get_payload(decode=True) or b""
            if given := part.get_filename():
                files.append((given, part.get_content_type(), len(body), body))
            elif part.get_content_type() in ("text/plain", "text/html"):
                text = body.decode(part.get_content_charset() or "utf-8", "replace")
                (plain if part.get_content_type() == "text/plain" else html).append(text)
        heads = (None if mail[h] is None else str(mail[h]) for h in ("Message-ID", "Date", "From", "To", "Subject"))
        return (number_of(name), name, *heads, "".join(plain), "".join(html), files, None)
    except (MessageError, LookupError, ValueError) as e:
        return (*empty, f"{type(e).__name__}: {e}"[:200])


#: Numbers to a shelf.
SHELF = 1000
#: Tasks beyond which several shelves go to one.
TASKS = 10_000


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Shelves(InputPartition):
    paths: list[str]
    after: int
    upto: int | None


class _Folder:
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.eml")
        self.after, self.most = int(options.get("after", -1)), int(options.get("most", 1000))
        self.per_batch = int(options["per_batch"]) if "per_batch" in options else None

    def open(self):
        from pyarrow.fs import FileSystem, LocalFileSystem

        return FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (LocalFileSystem(), self.path)

    def found(self, path: str) -> list:
        from pyarrow.fs import FileSelector

        return self.open()[0].get_file_info(FileSelector(path, allow_not_found=True))

    def files(self, found: list, after: int, upto: int | None = None) -> list[tuple[int, str]]:
        """(number, path) of the files beyond a number, and up to one, in order."""
        from pyarrow.fs import FileType

        files = [(number_of(x.base_name), x.path) for x in found if x.type == FileType.File and fnmatch(x.base_name, self.glob)]
        return sorted(x for x in files if x[0] > after and (upto is None or x[0] <= upto))

    def listed(self, after: int, upto: int | None = None) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
        """The files without a shelf, and (number, path) of the shelves, that may have such numbers."""
        from pyarrow.fs import FileType

        found = self.found(self.open()[1])
        shelves = [(int(x.base_name), x.path) for x in found if x.type == FileType.Directory and re.fullmatch(r"[0-9]{9}|[1-9][0-9]{9,}", x.base_name)]
        return self.files(found, after, upto), sorted(x for x in shelves if x[0] * SHELF + SHELF - 1 > after and (upto is None or x[0] * SHELF <= upto))

    def on_shelf(self, shelf: str, after: int, upto: int | None = None) -> list[tuple[int, str]]:
        """(number, path) of a shelf's files beyond a number, and up to one, in order."""
        first = int(shelf.rsplit("/", 1)[-1]) * SHELF
        last = first + SHELF - 1
        return self.files(self.found(shelf), max(after, first - 1), last if upto is None else min(upto, last))

    def latest(self, after: int) -> int:
        """The last number of the next ``per_batch`` files beyond one; that one, if there are none. Looks at one shelf after the other, and at no more than it needs."""
        files, shelves = self.listed(after)
        if self.per_batch is None:
            top = files[-1][0] if files else after
            for k, shelf in reversed(shelves):
                if k * SHELF + SHELF - 1 <= top:
                    break
                if found := self.on_shelf(shelf, top):
                    return found[-1][0]
            return top
        on_shelves = (x for _, shelf in shelves for x in self.on_shelf(shelf, after))
        last = after
        for last, _ in islice(merge(files, on_shelves), self.per_batch):
            pass
        return last

    def partitions(self, after: int, upto: int | None = None) -> list[InputPartition]:
        files, shelves = self.listed(after, upto)
        paths = [p for _, p in files]
        out = [Files(paths[i : i + self.most]) for i in range(0, len(paths), self.most)]
        if self.most < SHELF:
            for k, shelf in shelves:
                for low in range(k * SHELF - 1, (k + 1) * SHELF - 1, self.most):
                    high = min(low + self.most, (k + 1) * SHELF - 1)
                    if high > after and (upto is None or low < upto):
                        out.append(Shelves([shelf], max(low, after), high if upto is None else min(high, upto)))
        else:
            each = max(self.most // SHELF, -(-len(shelves) // TASKS))
            out += [Shelves([p for _, p in shelves[i : i + each]], after, upto) for i in range(0, len(shelves), each)]
        return out or [Files([])]

    def rows(self, partition: Files | Shelves) -> Iterator[tuple]:
        system, _ = self.open()
        paths = partition.paths if isinstance(partition, Files) else (p for shelf in partition.paths for _, p in self.on_shelf(shelf, partition.after, partition.upto))
        for path in paths:
            try:
                with system.open_input_stream(path) as file:
                    raw = file.read()
            except FileNotFoundError:
                continue
            yield parsed(path.rsplit("/", 1)[-1], raw)


class _Table(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self) -> list[InputPartition]:
        return self.folder.partitions(self.folder.after)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.ahead = _Folder(options), None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"number": self.folder.after}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last number of the next ``per_batch`` files beyond the one that was given out last."""
        self.ahead = self.folder.latest(self.folder.after if self.ahead is None else self.ahead)
        return {"number": self.ahead}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.ahead is None:  # a batch that is run again after a restart
            self.ahead = end["number"]
        return self.folder.partitions(start["number"], end["number"])

    def commit(self, end: dict) -> None:
        self.ahead = max(end["number"], -1 if self.ahead is None else self.ahead)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def composed(number: int, message_id: str | None, sender: str | None, subject: str | None, text: str | None, attachment: str | None, content: str | None) -> bytes:
    """A mail file's bytes: the text, and a text file beside it if ``attachment`` names one."""
    body = MIMEText(text or "", "plain", "utf-8")
    mail = body
    if attachment is not None:
        mail = MIMEMultipart()
        mail.attach(body)
        file = MIMEText(content or "", "plain", "utf-8")
        file.add_header("Content-Disposition", "attachment", filename=attachment)
        mail.attach(file)
    for name, value in (("From", sender), ("Subject", subject), ("Message-ID", message_id and f"<{message_id}>")):
        if value is not None:
            mail[name] = value
    return mail.as_bytes()


def write_mail(mails: DataFrame, folder: str) -> None:
    """Write mails (number, message_id, sender, subject, text, attachment, content) as files on the shelves of a mailbox, in tasks.

    A file is named by its number, so one that is written again is the same file.
    """
    names = ["number", "message_id", "sender", "subject", "text", "attachment", "content"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, path), shelf = _Folder({"path": folder}).open(), None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"inbox_{row[0]:012d}.eml"
                if shelf != (of := f"{path}/{number_of(name) // SHELF:09d}"):
                    system.create_dir(of, recursive=True)
                    shelf = of
                with system.open_output_stream(f"{of}/{name}") as file:
                    file.write(composed(*row))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    mails.select(*names).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def messages(mail: DataFrame) -> DataFrame:
    """Rows of the source as messages: names and addresses apart, the plain body or else the text of the HTML one, an id for each."""
    body = F.when(F.trim("plain") != "", F.col("plain")).otherwise(F.trim(strip_tags(F.col("html"))))
    bare = F.nullif(F.regexp_replace(F.trim(F.coalesce("message_id", F.lit(""))), "[<>]", ""), F.lit(""))
    key = F.coalesce(bare, F.concat(F.lit("IMAP-UID-"), F.col("number").cast("string")))
    return mail.filter("error is null").select("number", "filename", key.alias("message_id"), "date", sender_name(F.col("sender_raw")).alias("sender"), sender_address(F.col("sender_raw")).alias("sender_email"), "recipient", "subject", body.alias("body_text"), "attachments")


def read_mail(spark: SparkSession, folder: str) -> DataFrame:
    """number, filename, message_id, date, sender, sender_email, recipient, subject, body_text, attachments of every *.eml file."""
    spark.dataSource.register(MailSource)
    return messages(spark.read.format("mail").load(folder))


def mail_stream(spark: SparkSession, folder: str, after: int = -1, **options: int) -> DataFrame:
    """The same as a stream, beyond a number."""
    spark.dataSource.register(MailSource)
    return messages(spark.readStream.format("mail").options(after=after, **options).load(folder))
