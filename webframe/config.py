"""Crawl options that decide results; one field for each command-line option that has an effect on data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CrawlConfig:
    # extent
    recursive: bool = False
    level: int = 5
    page_requisites: bool = False
    page_requisites_level: int = 5
    tries: int = 20
    max_redirect: int = 20
    quota: int | None = None
    # filters
    https_only: bool = False
    follow_ftp: bool = False
    domains: tuple[str, ...] = ()
    exclude_domains: tuple[str, ...] = ()
    hostnames: tuple[str, ...] = ()
    exclude_hostnames: tuple[str, ...] = ()
    accept_regex: str | None = None
    reject_regex: str | None = None
    include_directories: tuple[str, ...] = ()
    exclude_directories: tuple[str, ...] = ()
    accept: tuple[str, ...] = ()
    reject: tuple[str, ...] = ()
    no_parent: bool = False
    span_hosts: bool = False
    span_hosts_allow: tuple[str, ...] = ()  # page-requisites, linked-pages
    strong_redirects: bool = True
    robots: bool = True
    user_agent: str = "webframe"
    # links
    follow_tags: tuple[str, ...] = ()
    ignore_tags: tuple[str, ...] = ()
    relative: bool = False
    sitemaps: bool = False
    link_extractors: tuple[str, ...] = ("html", "css", "javascript")
    strip_session_id: bool = False
    escaped_fragment: bool = False
    # results
    retry_connrefused: bool = False
    retry_dns_error: bool = False
    content_on_error: bool = False
    waitretry: float = 10.0
    wait: float = 0.0
    # files
    directory_prefix: str = "."
    use_directories: bool = True
    protocol_directories: bool = False
    host_directories: bool = True
    cut_dirs: int = 0
    default_page: str = "index.html"
    adjust_extension: bool = False
    content_disposition: bool = False
    restrict_file_names: tuple[str, ...] = field(default=("unix", "ascii"))
    max_filename_length: int | None = None
    delete_after: bool = False
    save_headers: bool = False
    output_document: bool = False  # all bodies as one document instead of files
    # archives
    warc_max_size: int | None = None
    warc_dedup: bool = False
    warc_cdx: bool = False
    # conversion
    convert_links: bool = False
    backup_converted: bool = False
