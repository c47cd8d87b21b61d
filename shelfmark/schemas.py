"""Declared schemas of the operational entities and of the raw and mart tables."""

from __future__ import annotations

MONEY = "decimal(18,2)"

ITEM = (
    "struct<product_id:string,product_name:string,quantity:bigint,"
    "unit_price:decimal(18,2),line_total:decimal(18,2)>"
)

ENTITIES: dict[str, str] = {
    "stores": "store_id string, name string, status string, created_at timestamp, updated_at timestamp",
    "products": (
        "store_id string, product_id string, name string, category string, price decimal(18,2), "
        "quantity_on_hand bigint, reorder_threshold bigint, expiry_date timestamp, expiry_status string, "
        "status string, created_at timestamp, updated_at timestamp"
    ),
    "stock_adjustments": (
        "adjustment_id string, store_id string, product_id string, adjustment_type string, "
        "quantity_delta bigint, reason string, source_ref string, created_by string, created_at timestamp"
    ),
    "transactions": (
        "transaction_id string, store_id string, idempotency_key string, customer_id string, status string, "
        "payment_method string, total_amount decimal(18,2), sale_timestamp timestamp, created_by string, "
        f"created_at timestamp, items array<{ITEM}>"
    ),
    "sale_requests": (
        "store_id string, idempotency_key string, customer_id string, payment_method string, "
        "requested_at timestamp, seq bigint, items array<struct<product_id:string,quantity:bigint>>"
    ),
    "idempotency": (
        "store_id string, idempotency_key string, request_hash string, transaction_id string, "
        "result_status string, total_amount decimal(18,2), created_at timestamp, last_seen_at timestamp"
    ),
    "customers": (
        "customer_id string, store_id string, name string, phone string, total_spend decimal(18,2), "
        "visit_count bigint, last_purchase_at timestamp, created_at timestamp, updated_at timestamp"
    ),
    "alerts": (
        "alert_id string, store_id string, alert_type string, condition_key string, source_entity_id string, "
        "status string, severity string, title string, message string, metadata string, created_at timestamp, "
        "last_evaluated_at timestamp, acknowledged_at timestamp, acknowledged_by string, resolved_at timestamp, "
        "resolved_by string, resolution_note string"
    ),
    "alert_events": (
        "event_id string, store_id string, alert_id string, from_status string, to_status string, "
        "changed_by string, note string, changed_at timestamp"
    ),
    "followups": (
        "task_id string, store_id string, kind string, subject_id string, status string, attempt_count int, "
        "error_message string, created_at timestamp, done_at timestamp"
    ),
    "chat_sessions": (
        "chat_session_id string, store_id string, user_id string, created_at timestamp, last_query_at timestamp"
    ),
    "messages": (
        "chat_session_id string, message_id string, store_id string, role string, text string, created_at timestamp"
    ),
    "pipeline_runs": (
        "pipeline_run_id string, store_id string, run_type string, status string, attempt_count int, "
        "checkpoint_start timestamp, checkpoint_end timestamp, records_read bigint, records_written bigint, "
        "failure_stage string, error_message string, started_at timestamp, finished_at timestamp"
    ),
    "pipeline_failures": (
        "failure_id string, pipeline_run_id string, store_id string, source_module string, batch_ref string, "
        "retry_count int, failure_stage string, dead_letter_status string, error_message string, "
        "created_at timestamp, recovered_at timestamp"
    ),
    "analytics_metadata": (
        "store_id string, analytics_last_updated_at timestamp, freshness_status string, "
        "last_pipeline_run_id string, source_window_start timestamp, source_window_end timestamp, "
        "updated_at timestamp"
    ),
}

RAW: dict[str, str] = {
    "transactions_raw": (
        "transaction_id string, store_id string, customer_id string, idempotency_key string, "
        "total_amount decimal(18,2), payment_method string, sale_timestamp timestamp, created_at timestamp"
    ),
    "transaction_items_raw": (
        "transaction_id string, store_id string, product_id string, product_name string, quantity bigint, "
        "unit_price decimal(18,2), line_total decimal(18,2), sale_timestamp timestamp"
    ),
    "inventory_snapshot_raw": (
        "snapshot_id string, store_id string, product_id string, product_name string, quantity_on_hand bigint, "
        "reorder_threshold bigint, expiry_date timestamp, captured_at timestamp"
    ),
    "customers_raw": (
        "customer_id string, store_id string, name string, phone string, total_spend decimal(18,2), "
        "visit_count bigint, last_purchase_at timestamp, captured_at timestamp"
    ),
    "alerts_raw": (
        "alert_id string, store_id string, alert_type string, status string, severity string, "
        "source_entity_id string, created_at timestamp, resolved_at timestamp, captured_at timestamp"
    ),
}

MARTS: dict[str, str] = {
    "sales_daily": (
        "store_id string, sales_date date, total_sales decimal(18,2), transaction_count bigint, "
        "average_basket_value double, analytics_last_updated_at timestamp"
    ),
    "product_sales_daily": (
        "store_id string, sales_date date, product_id string, product_name string, quantity_sold bigint, "
        "revenue decimal(18,2), analytics_last_updated_at timestamp"
    ),
    "demand_days": "store_id string, product_id string, sales_date date, units bigint",
    "customer_summary": (
        "store_id string, customer_id string, customer_name string, lifetime_spend decimal(18,2), "
        "visit_count bigint, last_purchase_at timestamp, analytics_last_updated_at timestamp"
    ),
    "inventory_health": (
        "store_id string, snapshot_date date, product_id string, product_name string, quantity_on_hand bigint, "
        "reorder_threshold bigint, days_to_expiry int, is_low_stock boolean, analytics_last_updated_at timestamp"
    ),
    "dashboard_summary": (
        "store_id string, snapshot_date date, today_sales decimal(18,2), today_transactions bigint, "
        "active_alert_count bigint, low_stock_count bigint, top_selling_product string, "
        "analytics_last_updated_at timestamp"
    ),
    "product_embeddings": (
        "store_id string, product_id string, product_name string, category string, embedding_text string, "
        "embedding array<double>, embedded_at timestamp, analytics_last_updated_at timestamp"
    ),
}

TABLES: dict[str, str] = {**ENTITIES, **RAW, **MARTS}

# Allowed values, as stored.
PRODUCT_STATUSES = ("ACTIVE", "INACTIVE")
ADJUSTMENT_TYPES = ("ADD", "REMOVE", "SALE_DEDUCTION", "MANUAL_CORRECTION")
SUBTRACTING_TYPES = ("REMOVE", "SALE_DEDUCTION")
PAYMENT_METHODS = ("cash", "upi", "card")
ALERT_STATUSES = ("ACTIVE", "ACKNOWLEDGED", "RESOLVED")
ALERT_TYPES = ("LOW_STOCK", "EXPIRY_SOON", "NOT_SELLING", "HIGH_DEMAND")
ALERT_SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
