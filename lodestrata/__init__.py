"""Content-addressed snapshots of file trees and document tables, as Spark plans."""

__version__ = "0.1.0"
