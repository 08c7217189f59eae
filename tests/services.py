"""The two example services as catalog tables."""

from crosswalk import model

ORDERS, BILLING = "order-service", "billing-service"
_ENTITIES = [(ORDERS, 0, "Order", "class", "Order.java", 9, []), (ORDERS, 1, "OrderItem", "class", "OrderItem.java", 6, []),
             (ORDERS, 2, "OrderStatus", "enum", "OrderStatus.java", 3, ["PENDING", "PAID", "SHIPPED", "CANCELLED"]),
             (BILLING, 0, "OrderRecord", "class", "models.py", 7, []), (BILLING, 1, "Invoice", "class", "models.py", 19, [])]
_FIELDS = {
    (ORDERS, "Order"): "orderId:integer customerId:integer totalAmount:decimal currencyCode:string createdAt:datetime "
                       "orderStatus:ref:OrderStatus items:list<ref:OrderItem> shippingCity=shipping_city:string",
    (ORDERS, "OrderItem"): "sku:string quantity:integer unitPrice:decimal",
    (BILLING, "OrderRecord"): "order_ref:integer client_id:integer amount_due:decimal currency:string placed_at:datetime "
                              "status:string city:string",
    (BILLING, "Invoice"): "invoice_id:string order_ref:integer client_id:integer amount_due:decimal currency:string issued_at:datetime",
}


def entities(spark):
    return spark.createDataFrame(_ENTITIES, model.ENTITIES_DDL)


def fields(spark):
    rows = []
    for (service, entity), text in _FIELDS.items():
        for i, part in enumerate(text.split()):
            name, ctype = part.split(":", 1)
            name, _, wire = name.partition("=")
            rows.append((service, entity, i, name, wire or name, ctype, "", False))
    return spark.createDataFrame(rows, model.FIELDS_DDL)


def service_pairing(spark):
    return spark.createDataFrame([(1, ORDERS, BILLING)], "pairing_id INT, provider_service STRING, consumer_service STRING")


def entity_pairing(spark, provider="Order", consumer="OrderRecord"):
    return spark.createDataFrame([(1, ORDERS, provider, BILLING, consumer)], "plan_id INT, provider_service STRING, "
                                 "provider_entity STRING, consumer_service STRING, consumer_entity STRING")
