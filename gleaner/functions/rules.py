"""Signal rules: (category, pattern, weight, reason)."""

# Patterns, weights and reasons by which results are defined.
SIGNAL_RULES = [
    ("request_handler", r"func\s*\(\w+\s*\*?\w*\)\s*(Put|Range|DeleteRange|Txn|Compact|Watch|LeaseGrant|LeaseRevoke|LeaseKeepAlive)\s*\(", 40, "gRPC handler method signature"),
    ("request_handler", r"func\s+\w*(Put|Range|Watch|Lease|Txn|Compact)\w*\s*\(", 35, "function name suggests handler role"),
    ("request_handler", r"\.(Register\w+Server|HandleFunc|Handle)\s*\(", 40, "server registration call"),
    ("request_handler", r"ServeHTTP\s*\(", 35, "HTTP handler method"),
    ("request_handler", r"(func\s+\(\w+\s+\*?\w+\)\s+(\w+)\s*\(.*\)\s*error)", 15, "method returning error, possible handler"),
    ("background_loop", r"time\.NewTicker\s*\(", 40, "periodic ticker created"),
    ("background_loop", r"time\.NewTimer\s*\(", 30, "timer created"),
    ("background_loop", r"\bticker\b", 10, "ticker variable reference"),
    ("background_loop", r"<-ctx\.Done\(\)", 30, "context cancellation check"),
    ("background_loop", r"go\s+func\s*\(", 20, "goroutine launch (possible background)"),
    ("admin_maintenance", r"\b(compaction|Compaction)\b", 35, "compaction reference"),
    ("admin_maintenance", r"\bdefrag\w*\b", 35, "defragmentation reference"),
    ("admin_maintenance", r"\b(snapshot|Snapshot)\b", 30, "snapshot reference"),
    ("admin_maintenance", r"\balarm\b", 25, "alarm reference"),
    ("admin_maintenance", r"\bquota\b", 25, "quota reference"),
    ("admin_maintenance", r"\b(restore|Restore)\b", 25, "restore operation"),
    ("admin_maintenance", r"\b(endpoint|Endpoint)\s+(status|Status)\b", 25, "endpoint status check"),
    ("admin_maintenance", r"\bmember\s+\w+\b", 15, "member management"),
    ("threshold_limit", r"\b(Quota|quota)\b", 35, "quota enforcement"),
    ("threshold_limit", r"\bexceed(ed|s)?\b", 30, "exceeded threshold"),
    ("threshold_limit", r"\btoo\s+(large|big|many)\b", 25, "too large/many reference"),
    ("threshold_limit", r"\bNOSPACE\b", 40, "no space error constant"),
    ("threshold_limit", r"\bResourceExhausted\b", 35, "resource exhausted"),
    ("threshold_limit", r"\bErrNoSpace\b", 35, "no space error"),
    ("consensus_state", r"\b(Propose|propose)\w*\s*\(", 35, "Raft proposal"),
    ("consensus_state", r"\bReady\b", 25, "Raft Ready state"),
    ("consensus_state", r"\b(apply|Apply)\w*\s*\(", 20, "apply call"),
    ("consensus_state", r"\b(committed|Committed)\b", 25, "committed state"),
    ("consensus_state", r"\b(leader|Leader)\b", 20, "leader role/predicate"),
    ("consensus_state", r"\b(follower|Follower)\b", 20, "follower role"),
    ("consensus_state", r"\b(election|Election)\b", 25, "election process"),
    ("consensus_state", r"\b(heartbeat|Heartbeat)\b", 25, "heartbeat mechanism"),
    ("consensus_state", r"\b(Campaign|Step)\s*\(", 25, "Raft campaign/step"),
    ("storage_durability", r"\bwal\b", 30, "WAL reference"),
    ("storage_durability", r"\b(snapshot|Snapshot)\b", 25, "snapshot persistence"),
    ("storage_durability", r"\b(fsync|fdatasync|Sync)\s*\(", 35, "fsync/sync call for durability"),
    ("storage_durability", r"\b(backend|Backend)\b", 20, "backend storage reference"),
    ("storage_durability", r"\b(bolt|bbolt|Bolt)\b", 30, "bolt/bbolt storage engine"),
    ("storage_durability", r"\b(commit|Commit)\s*\(", 20, "storage commit call"),
    ("storage_durability", r"\bpersist\w*\b", 15, "persistence reference"),
    ("observability", r"\b(metrics|Metrics)\b", 20, "metrics reference"),
    ("observability", r"\b(prometheus|Prometheus)\b", 25, "prometheus reference"),
    ("observability", r"\b(log|Log)ger\b", 15, "logger reference"),
    ("observability", r"\b(log|Log)\.(Info|Error|Warn|Debug)\w*\s*\(", 10, "log call"),
    ("observability", r"\b(tracing|Tracing|trace|Trace)\b", 15, "tracing reference"),
    ("scope_marker", r"\b(client/v3|ClientV3)\b", 20, "client-side v3 scope"),
    ("scope_marker", r"\bv3rpc\b", 25, "v3 RPC scope"),
    ("scope_marker", r"\bv2store\b", 15, "v2 store scope (legacy)"),
    ("scope_marker", r"\b(rafthttp|RaftHTTP)\b", 15, "raft HTTP transport scope"),
    ("scope_marker", r"\betcdserverpb\b", 15, "etcd server protobuf scope"),
    ("scope_marker", r"\bmvccpb\b", 15, "mvcc protobuf scope"),
]

#: Rules of the same form for prose: what the documents table can show.
PROSE_RULES = [
    ("license", r"\b(Licensed|Released)\b", 40, "license line"),
    ("license", r"\blicensed?\b", 30, "license word"),
    ("contact", r"[\w.+-]+@[\w-]+\.[a-z]+", 35, "mail address"),
    ("contact", r"\+1 \(\d{3}\) \d{3}-\d{4}", 35, "phone number"),
    ("secret", r"\b(token|secret|password)\b", 40, "secret-like word"),
    ("insult", r"\b(idiot|stupid|pathetic|worthless|scum)\b", 25, "insult"),
    ("shout", r"!!", 10, "double exclamation"),
    ("table", r" \| ", 15, "table cell"),
]
