"""Issue rules: one regular expression per label, most specific label first."""

# Fixed values. Patterns are matched anywhere in lower-cased text with straight apostrophes.
ISSUE_PATTERNS = {
    "Payment Issue": (
        r"(payment (failed|error|issue|problem|declined)|charged (twice|again)|double.?charged|"
        r"money (was )?deducted|amount (was )?deducted|billed twice|charged for (a|an|"
        r"the) .{0,30}(never|not)|never (actually )?ordered|invoice.{0,30}(discrepancy|wrong|mismatch|"
        r"error)|billing (error|issue|problem|mistake)|payment gateway|"
        r"payment confirmation.{0,20}(long|late|delay|never))"
    ),
    "Pricing / Overcharge": (
        r"(overcharg\w*|charged (slightly |a lot )?more|higher than (what was |the )?(advertised|"
        r"quoted|shown|price)|hidden (fee|charge|cost)s?|extra (charge|cost|fee)s?|unexpected charge|"
        r"price.{0,20}(too high|jumped|increase)|not worth (the|its) price|overpriced)"
    ),
    "Refund Not Processed": (
        r"(refund.{0,40}(not|haven.t|hasn.t|never|still|pending|waiting|denied|rejected|delay|took|"
        r"longer|no update)|(waiting|wait|waited) (for|on) (my |the )?refund|no refund|"
        r"want (a )?refund|need (a )?refund|return.{0,40}(marked complete|never showed|"
        r"label.{0,20}(didn.t|not) work|hasn.t happened|not (picked|collected))|pickup.{0,30}return|"
        r"return.{0,20}pickup.{0,40}(still|hasn.t|not)|sent back.{0,40}(no update|no response|"
        r"nothing))"
    ),
    "Wrong Product": (
        r"(wrong (item|product|order|size|colou?r)|sent (me )?(the )?wrong|received (the )?wrong|"
        r"different (product|item) (from|than)|not what i ordered)"
    ),
    "Damaged Product": (
        r"(damaged|dented|crushed|cracked|torn|shattered|arrived (broken|damaged|smashed)|"
        r"visible defects?|item unusable|box was crushed|scratched on arrival|scuff\w* on arrival)"
    ),
    "Product Not Working": (
        r"(not working|stopped (working|functioning|charging)|doesn.t (work|turn on|charge|function)|"
        r"malfunction\w*|won.t (turn on|charge|connect|pair)|dead on arrival|broke (the )?(first|"
        r"within|after)|broke (down|on me)|stopped .{0,20}after (less than )?a (week|day|month))"
    ),
    "Poor Product Quality": (
        r"(poor (build )?quality|bad quality|low quality|cheap(ly)? (made|feel|plastic|material)|"
        r"feels? (a bit )?(cheap|flimsy)|flimsy|quality control|showing wear|wear and tear|"
        r"scratch(es)? easily|rough finish|finish.{0,20}rough|different quality|not as (described|"
        r"shown|advertised)|completely different|falls apart|not worth (the|its) price|poor (finish|"
        r"material|build))"
    ),
    "Poor Customer Support": (
        r"(no (response|reply|resolution|fix|update|one (helped|replied|responded))|didn.t (respond|"
        r"reply)|did not (respond|reply)|(rude|unhelpful|useless|incompetent|dismissive).{0,30}(agent|"
        r"support|staff|representative)|(agent|support|staff|representative|"
        r"customer service).{0,30}(rude|unhelpful|useless|incompetent|dismissive)|(couldn.t|could not|"
        r"can.t|unable to|failed to|never) (actually )?resolve|never got resolved|"
        r"not (been )?resolved|unresolved|transferred (between|from)|explain my issue (multiple|again|"
        r"several)|had to (repeat|explain)|called support \d+|contact(ing|ed) support|"
        r"support (has not|hasn.t|did not|didn.t|never)|ignored my|customer service.{0,20}(bad|poor|"
        r"terrible|worst))"
    ),
    "Slow Customer Support": (
        r"(took \d+ days? to (respond|reply|answer)|slow(er)? (response|reply|to respond)|"
        r"response (eventually|felt slower|took)|long wait.{0,20}(support|agent|chat)|on hold for|"
        r"got a response eventually|slower than it should)"
    ),
    "Account Issue": (
        r"(can.t (update|change|edit|log ?in|sign in|access|reset)|unable to (log ?in|sign in|access|"
        r"update)|account.{0,15}(locked|blocked|suspended|hacked|problem|issue)|locked out|"
        r"password.{0,20}(reset|not work|issue)|otp.{0,20}(not|never|didn.t)|login.{0,15}(issue|"
        r"problem|fail|error))"
    ),
    "App / Website Issue": (
        r"((app|website|site|checkout|search|page|notifications?).{0,60}(crash\w*|slow|laggy|lag|"
        r"error|timed out|freez\w*|bug\w*|glitch\w*|inaccurate|inconsistent|not (load|work|"
        r"respond)\w*|down|broken|unresponsive)|(crash\w*|laggy|timed out|glitch\w*|"
        r"freez\w*).{0,40}(app|website|site|checkout|order)|can.t (complete|finish) (my )?(checkout|"
        r"order|payment)|keeps showing (an )?error|(search|website|app).{0,30}(doesn.t|does not|"
        r"not) (always )?(return|show|work|load))"
    ),
    "Missing / Lost Package": (
        r"(never (got|received|showed|arrived|came)|(haven.t|hasn.t|have not|has not|"
        r"not) (yet )?(received|arrived)|still haven.t received|package.{0,20}(lost|missing)|"
        r"parcel.{0,20}(lost|missing)|lost (in transit|package|parcel)|missing (item|package|parcel|"
        r"part|accessor\w*)|marked (it )?(as )?delivered|wrong address)"
    ),
    "Delivery Delay": (
        r"(deliver\w*.{0,60}(late|delay\w*|slow|took \d+|instead of|only once|far away|not (on time|"
        r"updated))|(late|delayed|delay)\b.{0,30}(deliver\w*|shipping|shipment|package|parcel|order|"
        r"courier)|(package|parcel|order|shipment).{0,40}(late|delay\w*|took \d+ days|showed up)|"
        r"(shipping|delivery|courier|tracking).{0,50}(wasn.t updated|not updated|no updates?|"
        r"standard (delivery|shipping)|only once|left it)|still waiting for (my )?(order|package|"
        r"delivery|parcel)|took (too long|longer than promised)|arrived (very )?late|"
        r"paid extra for express)"
    ),
    "Order Cancellation": (
        r"(order.{0,20}cancel\w*|cancellation|cancelled (it )?without|automatically cancel\w*)"
    ),
    "General Complaint": (
        r"(bad experience|terrible experience|horrible experience|frustrating experience|"
        r"worst.{0,20}(ever|experience)|very disappointed|extremely dissatisfied|underwhelming|"
        r"letdown|let down|forgettable|more hassle than|(would not|wouldn.t|won.t|will not|"
        r"not planning to) (recommend|order|purchase|buy)|never (buy|order|shop)\w* (from|again))"
    ),
}

NO_ISSUE = "General Feedback"
ANY_ISSUE = "General Complaint"

# Substrings of which every match of the label's pattern holds at least one. They are derived from
# the patterns above: a text without any of them is settled by plain substring search.
ISSUE_HINTS = {
    "Payment Issue": ["payment", "charged", "deducted", "billed", "ordered", "invoice", "billing"],
    "Pricing / Overcharge": ["charg", "higher than", "hidden", "extra", "price"],
    "Refund Not Processed": ["refund", "return", "sent back"],
    "Wrong Product": ["wrong", "different", "not what i ordered"],
    "Damaged Product": [
        "damaged", "dented", "crushed", "cracked", "torn", "shattered", "arrived", "visible defect",
        "unusable", "scratched", "scuff",
    ],
    "Product Not Working": [
        "not working", "stopped", "doesn", "malfunction", "won", "dead on arrival", "broke",
    ],
    "Poor Product Quality": [
        "quality", "cheap", "flimsy", "wear", "scratch", "finish", "not as", "completely different",
        "falls apart", "price", "poor",
    ],
    "Poor Customer Support": [
        "no response", "no resolution", "no fix", "no update", "no one", "reply", "respond", "rude",
        "unhelpful", "useless", "incompetent", "dismissive", "resolve", "transferred", "explain",
        "had to", "support", "ignored", "customer service",
    ],
    "Slow Customer Support": ["took", "slow", "response", "long wait", "on hold"],
    "Account Issue": ["can", "unable to", "account", "locked out", "password", "otp", "login"],
    "App / Website Issue": [
        "app", "site", "checkout", "search", "page", "notification", "crash", "laggy", "timed out",
        "glitch", "freez", "complete", "finish", "keeps showing",
    ],
    "Missing / Lost Package": [
        "never", "received", "arrived", "package", "parcel", "lost", "missing", "delivered",
        "wrong address",
    ],
    "Delivery Delay": [
        "deliver", "late", "delay", "took", "showed up", "shipping", "courier", "tracking",
        "still waiting for", "paid extra",
    ],
    "Order Cancellation": ["cancel"],
    "General Complaint": [
        "experience", "worst", "disappointed", "dissatisfied", "underwhelming", "letdown", "let down",
        "forgettable", "hassle", "recommend", "order", "purchase", "buy", "never",
    ],
}
