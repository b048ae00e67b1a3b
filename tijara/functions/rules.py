"""Rule tables.

FIXED VALUES — these must equal the source's cleaning rules for the results
to match.  They are kept here as plain data, in their natural order.
"""

from __future__ import annotations

# --- FIXED VALUES: payment label standardization (exact match, unmatched kept) ---
PAYMENT_LABELS: dict[str, str] = {
    "Autre": "Other",
    "Paiement à la livraison": "Cash on Delivery",
    "Versement CCP": "CCP Transfer",
    "Virement / Versement bancaire": "Bank Transfer",
    "Paiements par chèque": "Cheque Payment",
    "Paiement par chèque": "Cheque Payment",
    "Carte CIB & EDAHABIA": "CIB & Edahabia Card",
    "Carte CIB &amp; EDAHABIA": "CIB & Edahabia Card",
    "CIB / EDAHABIA": "CIB & Edahabia Card",
    "Espèces - Siège Social": "Cash - Siège Social",
    "Espèces - Bureau E-com": "Cash - E-commerce Office",
    "Espèces - Bureau Ecom": "Cash - E-commerce Office",
    "Espèces - Point d'enlèvement": "Cash - Pickup Point",
    "Other": "Other",
}
PAYMENT_UNKNOWN = "Unknown"

# --- FIXED VALUES: free-shipping words (case-insensitive, on the raw label) ---
FREE_SHIPPING_PATTERN = "gratuit|gratuite|free|مجانا"

# --- FIXED VALUES: shipping classes, case-insensitive, in order, first match wins ---
SHIPPING_RULES: list[tuple[str, str]] = [
    ("domicile|home|المنزل", "Home Delivery"),
    ("point de retrait|pick|نقطة", "Pickup Point"),
    ("Bureau|Expédition", "E-commerce Office"),
    ("point d'enlèvement|point d'enlévement|ADRAR|ALGER|BISKRA|BLIDA|BECHAR|CONSTANTINE|"
     "CONSTANTIN|DAR EL BEIDA|EL EULMA|BARIKA|GHARDAIA|ORAN|OUARGLA", "Collection Point"),
    ("International", "EMS International"),
]
SHIPPING_UNKNOWN = "Unknown"
# --- FIXED VALUES: labels kept as they are when no rule rewrote them ---
SHIPPING_VALID = ["Home Delivery", "Pickup Point", "Collection Point", "E-commerce Office", "EMS International"]

# --- FIXED VALUES: order status groups; unmapped statuses give null ---
STATUS_GROUPS: dict[str, str] = {
    "Terminée": "Completed",
    "En cours": "In Progress",
    "En livraison par NOEST": "In Progress",
    "En attente": "Pending",
    "Attente paiement": "Pending",
    "Partiellement payé": "Pending",
    "Retour NOEST": "Returned",
    "Remboursée": "Refunded",
    "Partiellement remboursée": "Partially Refunded",
}
# --- FIXED VALUES: realized (valid) sales statuses ---
REALIZED_STATUSES: list[str] = ["Terminée", "Partiellement remboursée"]

# --- FIXED VALUES: numeric columns coerced by name during typing ---
NUMERIC_COLUMNS: list[str] = ["quantity", "unit_price", "line_total", "order_total_amount",
                              "total_quantity", "n_lines", "shipping_cost", "Prix unitaire"]

# --- FIXED VALUES: measures that must be present on a transaction line ---
REQUIRED_LINE_MEASURES: list[str] = ["quantity", "unit_price", "line_total"]

# --- FIXED VALUES: customer id repair (5-digit stage ids get a leading zero) ---
CUSTOMER_ID_PATTERN = r"CLT_S(\d{5})$"
CUSTOMER_ID_REPLACEMENT = "CLT_S0$1"

# --- FIXED VALUES: dataset kinds recognised from canonical header names, in order ---
DATASET_HEADER_RULES: list[tuple[str, list[list[str]]]] = [
    # (dataset, alternatives of required header sets)
    ("transactions", [["order_id_stage", "quantity", "line_total"]]),
    ("orders", [["order_id_stage", "order_total_amount"]]),
    ("customers", [["customer_id_stage", "orders_count", "total_amount"]]),
    ("catalogue", [["sku", "product_name"], ["sku", "category"]]),
]
NEEDS_IDENTIFICATION = "needs_identification"

# --- FIXED VALUES: header aliases used for dataset detection (after folding) ---
DETECTION_HEADER_ALIASES: dict[str, str] = {
    "order id stage": "order_id_stage",
    "customer id stage": "customer_id_stage",
    "code client": "customer_id_stage",
    "quantity": "quantity",
    "line total": "line_total",
    "order total amount": "order_total_amount",
    "orders count": "orders_count",
    "total amount": "total_amount",
    "sku": "sku",
    "product name": "product_name",
    "nom": "product_name",
    "category": "category",
    "categorie": "category",
}

# --- FIXED VALUES: raw export headers renamed during cleaning ---
TRANSACTION_RENAMES: dict[str, str] = {
    "Code Client": "customer_id_stage",
    "Titre moyen du paiement": "payment_method",
    "Titre de la méthode d’expédition": "shipping_method",
    "Montant total de la commande": "order_total_amount",
    "Montant de l’expédition commande": "shipping_cost",
    "Poids total": "total_weight",
}
CATALOGUE_RENAMES: dict[str, str] = {
    "SkU": "sku",
    "Nom": "product_name",
    "categorie": "category",
    "Sous-catégorie": "subcategory",
    "Prix unitaire": "unit_price",
}

# --- FIXED VALUES: web-export preamble length ---
WEB_EXPORT_PREAMBLE_LINES = 9
# --- FIXED VALUES: engagement rate below which traffic is suspicious (percent) ---
LOW_ENGAGEMENT_PCT = 10.0

# --- FIXED VALUES: bubble and shade scaling for the region map ---
BUBBLE_MIN_RADIUS = 7.0
BUBBLE_RADIUS_RANGE = 21.0
SHADE_BASE = 38.0
SHADE_PER_SHARE = 2.25
SHADE_MAX = 88.0

# --- FIXED VALUES: forecast model order for tie-breaks ---
MODEL_ORDER: list[str] = ["Average", "Naive", "Seasonal Naive", "Drift", "SES",
                          "ARIMA(1,1,0)", "ARIMA(1,1,1)", "ARIMA(2,1,1)"]
SEASON_LENGTH = 12
TEST_SHARE = 0.2
FORECAST_HORIZON = 3
ACF_LAGS = 24
PACF_LAGS = 20
