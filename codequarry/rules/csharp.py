"""Interface rules for C#."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.patterns import Rx
from codequarry.functions.text import join_paths, let, mentions, strings_if
from codequarry.rules.base import Source, call, event_rows, grpc_rows, http_rows

# --- fixed values: patterns --------------------------------------------------
ASPNET_EVIDENCE = Rx(
    r"""Microsoft\.AspNetCore|WebApplication\.CreateBuilder|\bControllerBase\b|\[ApiController\]|\b[A-Za-z_]\w*\.Map(?:Get|Post|Put|Patch|Delete|Options|Head)\s*\(|\[Http(?:Get|Post|Put|Patch|Delete|Options|Head)\b""",
    faster=r"""[A-Za-z_[](?:(?<=M)icrosoft\.AspNetCore|(?<=W)ebApplication\.CreateBuilder|(?<=C)(?<!\wC)ontrollerBase\b|(?<=\[)(?:ApiController\]|Http(?:Get|Post|Put|Patch|Delete|Options|Head)\b)|(?<=\w)(?<!\w\w)\w*+\.Map(?:Get|Post|Put|Patch|Delete|Options|Head)\s*+\()""",
)
# The evidence in a text without ".Map".
ASPNET_OTHER_EVIDENCE = Rx(
    r"""[MWC[](?:(?<=M)icrosoft\.AspNetCore|(?<=W)ebApplication\.CreateBuilder|(?<=C)(?<!\wC)ontrollerBase\b|(?<=\[)(?:ApiController\]|Http(?:Get|Post|Put|Patch|Delete|Options|Head)\b))"""
)
ASPNET_MAP = Rx(
    r"""\b[A-Za-z_]\w*\.Map(Get|Post|Put|Patch|Delete|Options|Head)\s*\(\s*(?:@?\$?|\$?@?)["']([^"'`]+)["']""",
    faster=r"""[A-Za-z_](?<!\w[A-Za-z_])\w*+\.Map(Get|Post|Put|Patch|Delete|Options|Head)\s*+\(\s*+(?:@?\$?|\$?@?)["']([^"'`]+)["']""",
)
ASPNET_ATTRIBUTE = Rx(
    r"""\[(HttpGet|HttpPost|HttpPut|HttpPatch|HttpDelete|HttpOptions|HttpHead)\s*(?:\(([^)]*)\))?\]"""
)
ASPNET_CLASS_ROUTE = Rx(
    r"""\[Route\s*\(\s*(?:@?\$?|\$?@?)["']([^"'`]+)["']\s*\)\][\s\S]{0,300}?\bclass\s+\w+"""
)
STRING = Rx(r"""(?:@?\$?|\$?@?)["']([^"'`]+)["']""")

SIGNALR_EVIDENCE = Rx(
    r"""Microsoft\.AspNetCore\.SignalR|:\s*Hub(?:<[^>]+>)?\b|\bClients\.(?:All|Caller|Group|Others)\b|\bSendAsync\s*\(""",
    faster=r"""[M:CS](?:(?<=M)icrosoft\.AspNetCore\.SignalR|(?<=:)\s*+Hub(?:<[^>]+>)?\b|(?<=C)(?<!\wC)lients\.(?:All|Caller|Group|Others)\b|(?<=S)(?<!\wS)endAsync\s*+\()""",
)
SIGNALR_SEND = Rx(r"""\bSendAsync\s*\(\s*(?:@?\$?|\$?@?)["']([^"'`]+)["']""")
SIGNALR_METHOD = Rx(r"""\bpublic\s+(?:async\s+)?(?:Task|ValueTask|void)\s+([A-Z][A-Za-z_]\w*)\s*\(""")
SIGNALR_LIFECYCLE = ("OnConnectedAsync", "OnDisconnectedAsync")
SIGNALR_CLIENT_ON = Rx(r"""\.On(?:<[^>]+>)?\s*\(\s*(?:@?\$?|\$?@?)["']([^"'`]+)["']""")

GRPC_EVIDENCE = Rx(
    r"""Grpc\.Core|Grpc\.AspNetCore|MapGrpcService\s*<|:\s*[A-Za-z_]\w*\.[A-Za-z_]\w*Base\b"""
)
GRPC_BASE = Rx(r""":\s*([A-Za-z_]\w*)\.([A-Za-z_]\w*Base)\b""")
GRPC_OVERRIDE = Rx(r"""\bpublic\s+override\s+[\s\S]{0,160}?\s+([A-Z][A-Za-z_]\w*)\s*\(""")
# -----------------------------------------------------------------------------


def aspnet_core(src: Source) -> Column:
    """Minimal-API maps with their path as written, then attribute routes."""
    text = src.text
    gate = mentions(
        text, "AspNetCore", "WebApplication", "ControllerBase", "ApiController", ".Map", "[Http"
    ) & F.when(mentions(text, ".Map"), ASPNET_EVIDENCE.found_in(text)).otherwise(
        ASPNET_OTHER_EVIDENCE.found_in(text)
    )
    mapped = F.transform(
        strings_if(mentions(text, ".Map"), ASPNET_MAP.all(text)),
        lambda m: call(F.upper(ASPNET_MAP.part(m, 1)), ASPNET_MAP.part(m, 2)),
    )
    attributed = let(
        ASPNET_CLASS_ROUTE.part(text, 1),
        lambda prefix: F.transform(
            ASPNET_ATTRIBUTE.all(text),
            lambda m: call(
                F.upper(F.regexp_extract(m, r"\A\[Http([A-Z][a-z]+)", 1)),
                join_paths(prefix, STRING.part(ASPNET_ATTRIBUTE.part(m, 2), 1), strip_end=True),
            ),
        ),
    )
    return http_rows("ASP.NET Core", strings_if(gate, F.concat(mapped, attributed)))


def signalr(src: Source) -> Column:
    text = src.text
    gate = mentions(text, "SignalR", "Hub", "Clients.", "SendAsync") & SIGNALR_EVIDENCE.found_in(
        text
    )
    methods = F.filter(
        SIGNALR_METHOD.all(text, 1), lambda name: ~name.isin(*SIGNALR_LIFECYCLE)
    )
    served = strings_if(gate, F.concat(SIGNALR_SEND.all(text, 1), methods))
    heard = strings_if(gate, SIGNALR_CLIENT_ON.all(text, 1))
    return F.concat(
        event_rows("signalr", "SignalR", served),
        event_rows("signalr", "SignalR", heard, role="client"),
    )


def grpc(src: Source) -> Column:
    gate = mentions(src.text, "Grpc", "Base") & GRPC_EVIDENCE.found_in(src.text)
    names = F.concat(GRPC_BASE.all(src.text, 1), GRPC_OVERRIDE.all(src.text, 1))
    found = F.when(gate, names)
    return let(found, lambda names: grpc_rows(names))
