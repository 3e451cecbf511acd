"""The engine over HTTP, with the standard library's server: health, configurations, and files in for profiles out.

    python -m claimloom.service [--port 8000] [--configs FOLDER] [--samples FOLDER] [--cache PARQUET]

A request's files are written under their base names to a fresh folder of the shared storage, so executors see them.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path, PurePosixPath, PureWindowsPath

from pyspark.sql import SparkSession

from claimloom import engine, render
from claimloom.config import ConfigError, OutputConfig, default_config
from claimloom.operators import enrich
from claimloom.sources.files import claims_of, prose_of, read_files
from claimloom.storage import scratch


class BadRequest(ValueError):
    """What the caller got wrong."""


@dataclass
class Service:
    """What requests share: the session, a folder of named configurations, a folder of samples, a cache of answers."""

    spark: SparkSession
    configs_folder: str | None = None
    samples: str | None = None
    cache: str | None = None

    def health(self) -> dict:
        return {"status": "ok"}

    def configs(self) -> dict:
        """Names and contents of the configurations that can be read; ``default`` comes first."""
        items = [{"name": "default", "config": default_config().to_obj()}]
        for path in sorted(Path(self.configs_folder).glob("*.json")) if self.configs_folder else ():
            try:
                items.append({"name": path.stem, "config": OutputConfig.from_file(path).to_obj()})
            except ConfigError:
                continue
        return {"configs": items}

    def config(self, chosen: str) -> OutputConfig:
        """``default``, a configuration as JSON, or the name of one in the folder."""
        if chosen in ("", "default"):
            return default_config()
        if chosen.lstrip().startswith("{"):
            try:
                return OutputConfig.from_obj(json.loads(chosen))
            except json.JSONDecodeError as e:
                raise BadRequest(f"invalid inline config JSON: {e}") from e
        # a name only, never a path
        if self.configs_folder is None or chosen != PurePosixPath(chosen).name:
            raise BadRequest(f"config error: no configuration {chosen!r}")
        return OutputConfig.from_file(Path(self.configs_folder) / f"{chosen.removesuffix('.json')}.json")

    def transform(self, files: list[tuple[str, bytes]], config: str = "default", want_enrich: bool = False) -> dict:
        """Profiles of uploaded (name, content) files, in an envelope with count and what was filled in."""
        if not files:
            raise BadRequest("no files uploaded")
        folder = scratch(self.spark, "uploads")
        jvm = self.spark._jvm
        for name, content in files:
            base = PureWindowsPath(PurePosixPath(name or "source").name).name or "source"
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{base}")
            out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
            out.write(content)
            out.close()
        return self.answer([folder], config, want_enrich)

    def transform_samples(self, config: str = "default", want_enrich: bool = False) -> dict:
        if not self.samples or not Path(self.samples).exists():
            raise FileNotFoundError("bundled samples not found")
        return self.answer([self.samples], config, want_enrich)

    def answer(self, paths: list[str], chosen: str, want_enrich: bool) -> dict:
        try:
            config = self.config(chosen)
        except ConfigError as e:
            raise BadRequest(f"config error: {e}") from e
        claims = claims_of(self.spark, paths)
        profiles = engine.build_profiles(claims)
        settings = config.enrichment or enrich_settings()
        wanted = want_enrich or bool(config.enrichment and config.enrichment.enabled)
        report, status = [], "off"
        if wanted and self.cache:
            context = enrich.contexts(profiles, claims, prose_of(read_files(self.spark, paths)))
            filled = enrich.run(profiles, context, self.cache, settings.model, settings.fields)
            report = [r.asDict() for r in enrich.report(profiles, filled, settings.model).collect()]
            profiles, status = filled, "on"
        elif wanted:
            status = "enrichment was requested but no cache of answers is set: empty fields stay empty"
        try:
            text = render.render_json(profiles, config)
        except Exception as e:  # noqa: BLE001  what a configuration forbids is the caller's to mend
            raise BadRequest(f"transform failed: {str(e).splitlines()[0]}") from e
        candidates = json.loads(text)
        candidates = candidates if isinstance(candidates, list) else [candidates]
        return {"candidates": candidates, "count": len(candidates), "enriched": status == "on", "enrichment_status": status, "enrichment_report": report}


def enrich_settings():
    from claimloom.config import EnrichmentConfig

    return EnrichmentConfig()


def form(content_type: str, body: bytes) -> tuple[list[tuple[str, bytes]], dict[str, str]]:
    """(files, fields) of a multipart form; a file is a part with a file name."""
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    files, fields = [], {}
    for part in message.iter_parts() if message.is_multipart() else ():
        content = part.get_payload(decode=True) or b""
        if part.get_filename() is not None:
            files.append((part.get_filename(), content))
        else:
            fields[part.get_param("name", header="content-disposition")] = content.decode("utf-8", "replace")
    return files, fields


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, value: dict) -> None:
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            found = {"/api/health": service.health, "/api/configs": service.configs}.get(self.path)
            self.reply(200, found()) if found else self.reply(404, {"detail": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            files, fields = form(self.headers.get("Content-Type") or "", body)
            chosen, wanted = fields.get("config", "default"), fields.get("enrich", "").lower() in ("1", "true", "on", "yes")
            try:
                if self.path == "/api/transform":
                    self.reply(200, service.transform(files, chosen, wanted))
                elif self.path == "/api/transform/samples":
                    self.reply(200, service.transform_samples(chosen, wanted))
                else:
                    self.reply(404, {"detail": "not found"})
            except BadRequest as e:
                self.reply(400, {"detail": str(e)})
            except FileNotFoundError as e:
                self.reply(404, {"detail": str(e)})

        def log_message(self, *args: object) -> None:
            """Quiet: the session's own log tells enough."""

    return Handler


def serve(service: Service, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound but not running yet; port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), handler(service))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="claimloom.service", description=__doc__)
    parser.add_argument("--port", type=int, default=8000)
    parser.add_argument("--configs")
    parser.add_argument("--samples")
    parser.add_argument("--cache")
    args = parser.parse_args(argv)
    serve(Service(engine.session(), args.configs, args.samples, args.cache), args.port).serve_forever()


if __name__ == "__main__":
    main()
