"""Action templates per issue."""

# Fixed values: (action, details, kpi, department).
ACTIONS = {
    "Delivery Delay": (
        "Review Logistics Partner Performance",
        ("Audit delivery SLAs with current logistics partners. Implement real-time shipment tracking "
         "and proactive delay notifications. Consider diversifying to multiple delivery partners to "
         "reduce bottlenecks."),
        "Target: Reduce average delivery time by 30% within 60 days.",
        "Supply Chain / Operations",
    ),
    "Missing / Lost Package": (
        "Strengthen Package Tracking & Insurance",
        ("Mandate GPS tracking for all shipments above a threshold value. Introduce automatic "
         "refund/reship policy for packages lost in transit. Audit high-loss delivery routes and "
         "carriers."),
        "Target: Reduce lost package complaints by 80% within 90 days.",
        "Logistics / Customer Success",
    ),
    "Damaged Product": (
        "Improve Packaging Standards",
        ("Conduct packaging stress tests for fragile product categories. Train warehouse staff on "
         "proper packing procedures. Introduce double-boxing for high-value or fragile items."),
        "Target: Reduce product damage complaints by 60% within 45 days.",
        "Warehouse / Quality Assurance",
    ),
    "Wrong Product": (
        "Enhance Order Verification Process",
        ("Implement barcode scanning at packing stations to verify every item. Introduce quality-check"
         " step before dispatch for large orders. Audit order processing system for known error "
         "patterns."),
        "Target: Achieve 99.5% order accuracy within 30 days.",
        "Warehouse Operations",
    ),
    "Refund Not Processed": (
        "Streamline Refund Processing Pipeline",
        ("Automate refund initiation upon return confirmation. Set a maximum 3-business-day SLA for "
         "refund processing. Create a dedicated refund status tracker visible to customers."),
        "Target: Process 95% of refunds within 3 business days.",
        "Finance / Customer Support",
    ),
    "Payment Issue": (
        "Audit Payment Gateway & Billing System",
        ("Conduct a technical audit of the payment gateway for double-charge scenarios. Implement "
         "automatic reconciliation to detect billing anomalies. Provide instant refund for verified "
         "overcharges within 24 hours."),
        "Target: Resolve all payment anomalies within 24 hours.",
        "Finance / Engineering",
    ),
    "Poor Customer Support": (
        "Improve Customer Support Quality & Training",
        ("Conduct mandatory soft-skills training for all support agents. Implement customer "
         "satisfaction (CSAT) scoring after each interaction. Establish a quality assurance review of "
         "10% of all support tickets weekly."),
        "Target: Achieve CSAT score ≥ 4.0/5.0 within 60 days.",
        "Customer Support",
    ),
    "Slow Customer Support": (
        "Reduce Support Response Time",
        ("Review and enforce first-response SLA (target: 2 hours for email, 5 min for chat). Increase "
         "support staff during identified peak hours. Implement AI-based ticket routing for faster "
         "resolution."),
        "Target: First response time under 2 hours for 90% of tickets.",
        "Customer Support Operations",
    ),
    "Product Not Working": (
        "Investigate & Fix Product Reliability Issues",
        ("Conduct a product quality audit for reported SKUs. Introduce mandatory QA testing before "
         "batch shipment. Create a fast-track replacement program for defective products."),
        "Target: Reduce product defect complaints by 70% within 90 days.",
        "Product Quality / Engineering",
    ),
    "Poor Product Quality": (
        "Enhance Quality Control Standards",
        ("Tighten supplier quality standards and conduct random batch testing. Introduce customer-"
         "reported quality feedback loop into production cycle. Consider third-party quality "
         "certification for key product lines."),
        "Target: Reduce quality complaints by 50% within 90 days.",
        "Procurement / Quality Assurance",
    ),
    "App / Website Issue": (
        "Prioritize Platform Stability & UX Improvements",
        ("Conduct a comprehensive performance audit of the app and website. Fix identified crash "
         "points and implement error monitoring (e.g., Sentry). Run monthly UX testing sessions with "
         "real users."),
        "Target: Achieve 99.9% uptime and reduce crash reports by 80%.",
        "Engineering / Product",
    ),
    "Account Issue": (
        "Simplify Account & Authentication Flow",
        ("Streamline the password reset and OTP verification process. Implement social login "
         "(Google/Apple) to reduce friction. Add 24/7 account recovery support for locked accounts."),
        "Target: Reduce account-related support tickets by 60%.",
        "Engineering / Customer Support",
    ),
    "Pricing / Overcharge": (
        "Review & Communicate Pricing Policy Clearly",
        ("Audit all pricing tiers and hidden fees. Display total cost breakdown clearly during "
         "checkout. Send proactive communication about any pricing changes."),
        "Target: Reduce pricing complaint rate to below 2%.",
        "Finance / Marketing",
    ),
    "Order Cancellation": (
        "Improve Order Stability & Communication",
        ("Review triggers for automatic order cancellation and fix false positives. Notify customers "
         "immediately with clear reasons for any cancellation. Provide an easy order reinstatement "
         "flow."),
        "Target: Reduce unintended cancellations by 90%.",
        "Operations / Engineering",
    ),
    "General Complaint": (
        "Establish Structured Customer Feedback Response Process",
        ("Implement a systematic process for reviewing and responding to all complaints. Create a "
         "customer experience task force to address recurring pain points. Track and report complaint "
         "resolution rate monthly."),
        "Target: Respond to 100% of complaints within 48 hours.",
        "Customer Experience",
    ),
}

DEFAULT_ACTION = (
    "Monitor and Address Emerging Issue",
    "Conduct further analysis of this issue cluster and assign it to the relevant team.",
    "Track resolution rate monthly.",
    "Customer Experience",
)
