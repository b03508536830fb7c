"""A small vendor application as facts: a form, a page, two route handlers, and what they call and touch."""

from graphquarry.facts import of_rows

FILES = ["src/lib/vendors/create.ts", "src/lib/vendors/errors.ts", "src/lib/vendors/submit.ts", "src/lib/auth/session.ts", "src/lib/billing/invoice.ts", "src/app/api/vendors/route.ts",
         "src/components/VendorForm.tsx", "src/app/vendors/new/page.tsx", "src/lib/ui/toast.ts", "src/lib/db.ts", "test/vendors.test.ts", "prisma/schema.prisma"]
FUNCTIONS = {
    0: [("createVendor", 24, 1), ("getVendor", 39, 1), ("listVendors", 44, 1)], 1: [("isDuplicateEmailError", 22, 1), ("DuplicateVendorEmailError.constructor", 33, 1)], 2: [("submitVendor", 17, 1)],
    3: [("UnauthorizedError.constructor", 20, 1), ("readSessionCookie", 26, 0), ("getSession", 33, 1), ("requireSession", 46, 1)], 4: [("createInvoice", 12, 1), ("listUnpaidInvoices", 16, 1), ("markInvoicePaid", 20, 1)],
    5: [("POST", 14, 1), ("GET", 30, 1)], 6: [("VendorForm", 15, 1), ("VendorForm.handleSubmit", 19, 0), ("VendorForm.set", 30, 0)], 7: [("NewVendorPage", 4, 1)], 8: [("showToast", 11, 1), ("onToast", 16, 1)],
}
TEXT = {"submitVendor": ["Vendor created.", "Something went wrong"], "POST": ["vendor create failed", "Something went wrong"], "VendorForm": ["Contact name", "Add vendor"]}
TYPES = [("NewVendor", "interface", 0, 1), ("SubmitResult", "interface", 2, 1), ("SessionUser", "interface", 3, 1), ("Toast", "interface", 8, 1), ("PrismaKnownError", "interface", 1, 0), ("ToastKind", "alias", 8, 1), ("DuplicateVendorEmailError", "class", 1, 1), ("UnauthorizedError", "class", 3, 1)]
CALLS = """POST requireSession; POST createVendor; GET requireSession; GET listVendors; requireSession getSession; requireSession UnauthorizedError.constructor; getSession readSessionCookie;
submitVendor showToast; submitVendor showToast; VendorForm.handleSubmit submitVendor; VendorForm VendorForm.handleSubmit contains; VendorForm VendorForm.set contains; NewVendorPage VendorForm render"""
TOUCHES = "createVendor Vendor create; getVendor Vendor findUnique; listVendors Vendor findMany; getSession Session findUnique; getSession User findUnique; createInvoice Invoice create; listUnpaidInvoices Invoice findMany; markInvoicePaid Invoice update"
IMPORTS = [(0, 9), (3, 9), (4, 9), (2, 8), (2, 0), (5, 0), (5, 3), (6, 2), (6, 0), (7, 6), (10, 1)]
REFERENCES = "createVendor NewVendor; submitVendor NewVendor; POST NewVendor; VendorForm NewVendor; VendorForm.set NewVendor; submitVendor SubmitResult; getSession SessionUser; requireSession SessionUser; isDuplicateEmailError PrismaKnownError; showToast ToastKind; showToast Toast; onToast Toast; Toast ToastKind"
FIELDS = {"Vendor": "id name email contact phone status createdAt invoices", "User": "id email name role sessions", "Session": "id token userId user", "Invoice": "id vendorId amount paid issuedAt vendor"}


def facts(spark):
    where = {name: FILES[i] for i, fs in FUNCTIONS.items() for name, _, _ in fs}
    fn = lambda name: f"r|function:{where[name]}#{name}"
    of_type = {name: f"r|type:{FILES[i]}#{name}" for name, _, i, _ in TYPES}
    split = lambda text: [part.split() for part in text.replace("\n", " ").split(";")]
    file = lambda i: f"r|file:{FILES[i]}"
    writes = {"create", "update"}
    return of_rows(
        spark,
        files=[(file(i), p) for i, p in enumerate(FILES)],
        functions=[(fn(n), n, FILES[i], line, line + 4, bool(x), n[0].isupper() and FILES[i].endswith("x") and "." not in n, False, TEXT.get(n), f"{FILES[i]}#{n.split('.')[0]}") for i, fs in FUNCTIONS.items() for n, line, x in fs],
        types=[(of_type[n], n, kind, FILES[i], 1, bool(x)) for n, kind, i, x in TYPES],
        routes=[(f"r|route:{m} /api/vendors", m, "/api/vendors", fn(m), FILES[5], line) for m, line in (("POST", 14), ("GET", 30))],
        models=[(f"r|model:{m}", m, FILES[11]) for m in FIELDS],
        fields=[(f"r|field:{m}.{f}", m, f, "String", f == "email", f == "id") for m, fs in FIELDS.items() for f in fs.split()],
        calls=[(fn(a), fn(b), where[a], 1, "render" in flag, "contains" in flag) for a, b, *flag in split(CALLS)],
        references=[(of_type.get(a) or fn(a), of_type[b], None, 1) for a, b in split(REFERENCES)],
        touches=[(fn(a), f"r|model:{m}", op, op in writes, where[a], 1) for a, m, op in split(TOUCHES)],
        imports=[(file(a), file(b)) for a, b in IMPORTS],
    )
